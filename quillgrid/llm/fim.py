"""Fill-in-the-middle transformation by lookaround splitting. DataFrame functions only.

A unit grammar says which neighbouring characters stay together, as pairs of
character classes (left, right). It is translated to one zero-width regex that
matches between two characters unless a pair holds for them, and Spark's
``split`` cuts the text there; since nothing is consumed, the pieces joined
are the text. Empty texts have no position to cut and are dealt with apart:
``split`` would give one empty piece.

Two cuts among the n + 1 unit borders, drawn from a digest of the id, make
prefix, middle and suffix. A text is written plain, as prefix-suffix-middle
(psm) or as suffix-prefix-middle (spm), with a sentinel before each part.
Texts that hold a sentinel stay plain, so ``restore`` finds the parts by the
sentinels alone: none of them can arise where a part meets a sentinel, as
each begins with a character that stands nowhere else in it.

Null texts count as empty and are plain. A null id draws as an empty one.
Repeated rows, and rows of one id, draw alike. Texts are cut whole, however
long; the pieces of one text lie in one task's memory. An empty table gives an
empty result. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Grammar:
    """Neighbours that stay in one unit: (class of the left character, class of the right one)."""

    joins: tuple[tuple[str, str], ...]

    def boundary(self) -> str:
        """Regex of the empty strings between units."""
        inside = "".join(f"(?!(?<={left}){right})" for left, right in self.joins)
        return rf"(?<=[\s\S])(?=[\s\S]){inside}"


#: Runs of ASCII letters; any other character is a unit.
LETTERS = Grammar((("[A-Za-z]", "[A-Za-z]"),))
#: Words with the white space that follows them.
WORDS = Grammar(((r"\S", r"[\s\S]"), (r"\s", r"\s")))
#: Lines with their line feeds.
LINES = Grammar((("[^\n]", r"[\s\S]"),))
CHARACTERS = Grammar(())


@dataclass(frozen=True)
class Format:
    """Sentinels, and the shares of hundred: ids at ``plain_from`` or above stay plain, ids below ``spm_below`` are spm."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    plain_from: int = 90
    spm_below: int = 20
    seed: str = "1"

    def __post_init__(self) -> None:
        marks = self.sentinels
        if len(set(marks)) < 3 or any(not m or m[0] in m[1:] or any(m in x for x in marks if x != m) for m in marks) or len({m[0] for m in marks}) > 1:
            raise ValueError("sentinels must differ, share their first character, and hold it nowhere else")

    @property
    def sentinels(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle


def units(text: Column, grammar: Grammar = LETTERS) -> Column:
    """The units of a text, in order; none for an empty one."""
    return F.when(F.length(text) > 0, F.split(text, grammar.boundary(), -1)).otherwise(F.array().cast("array<string>"))


def draws(doc_id: Column, seed: str, n: int = 4) -> list[Column]:
    """``n`` unsigned 32-bit numbers from the digest of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(n)]


def transform(docs: DataFrame, grammar: Grammar = LETTERS, form: Format = Format()) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output): ``n`` units; lengths in characters, null where plain."""
    h = draws(F.col("doc_id"), form.seed)
    cut = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *(x.alias(f"h{i}") for i, x in enumerate(h, 1)))
    cut = cut.withColumn("units", units(F.col("text"), grammar)).withColumn("n", F.size("units"))
    a, b = F.col("h1") % (F.col("n") + 1), F.col("h2") % (F.col("n") + 1)
    held = F.lit(False)
    for mark in form.sentinels:
        held = held | F.contains("text", F.lit(mark))
    plain = (F.col("n") == 0) | held | (F.col("h3") % 100 >= form.plain_from)
    rows = cut.select(
        "doc_id", "text", "units", F.col("n").cast("long").alias("n"), F.least(a, b).cast("int").alias("a"), F.greatest(a, b).cast("int").alias("b"),
        F.when(plain, "plain").when(F.col("h4") % 100 < form.spm_below, "spm").otherwise("psm").alias("form"),
    )
    part = lambda start, length: F.array_join(F.slice("units", start, length), "")
    parts = rows.select(
        "doc_id", "text", "n", "form", part(F.lit(1), F.col("a")).alias("p"), part(F.col("a") + 1, F.col("b") - F.col("a")).alias("m"), part(F.col("b") + 1, F.col("n").cast("int") - F.col("b")).alias("s"),
    )
    p, s, m = (F.concat(F.lit(mark), c) for mark, c in zip(form.sentinels, ("p", "s", "m"), strict=True))
    output = F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "spm", F.concat(s, p, m)).otherwise(F.concat(p, s, m))
    chars = lambda c: F.when(F.col("form") != "plain", F.length(c).cast("long"))
    return parts.select("doc_id", "n", "form", chars("p").alias("prefix_chars"), chars("m").alias("middle_chars"), output.alias("output"))


def restore(output: Column, form: Column, how: Format = Format()) -> Column:
    """The text that an output was made of."""
    parts = F.split(output, "|".join(re.escape(m) for m in how.sentinels), -1)
    at = lambda i: F.get(parts, F.lit(i))
    return F.when(form == "plain", output).when(form == "spm", F.concat(at(2), at(3), at(1))).otherwise(F.concat(at(1), at(3), at(2)))


#: What the query returns, in DuckDB's SQL.
ORACLE = r"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS units, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS digest FROM documents
), drawn AS (
  SELECT *, len(units) AS n, ('0x' || substr(digest, 1, 8))::BIGINT AS h1, ('0x' || substr(digest, 9, 8))::BIGINT AS h2, ('0x' || substr(digest, 17, 8))::BIGINT AS h3, ('0x' || substr(digest, 25, 8))::BIGINT AS h4 FROM cut
), placed AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn
), parts AS (
  SELECT doc_id, text, n, form, coalesce(array_to_string(units[1:a], ''), '') AS p, coalesce(array_to_string(units[a + 1:b], ''), '') AS m, coalesce(array_to_string(units[b + 1:n], ''), '') AS s FROM placed
), written AS (
  SELECT *, CASE form WHEN 'plain' THEN text WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE '<P>' || p || '<S>' || s || '<M>' || m END AS output FROM parts
), pieces AS (
  SELECT *, string_split_regex(output, '<[PSM]>') AS o FROM written
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(output) AS output_sha256, sha256(CASE form WHEN 'plain' THEN output WHEN 'spm' THEN o[3] || o[4] || o[2] ELSE o[2] || o[4] || o[3] END) AS restored_sha256
FROM pieces
"""
