"""License scans by canonical digest lookup.

A text is made canonical (lower case, copyright lines dropped, punctuation and white space
to single spaces, equivalent spellings to one) and its SHA-256 digest is joined with the
digests of known licence texts. The entire text is looked up, and so is each of its lines
by itself, against known one-line notices.

Native: DataFrame functions only. A line longer than twice the longest notice, after folding
(when its blanks are single ones), can't equal a known one, as spelling changes a word's
length by far less, and is not spelled out.

Edge cases: null and empty texts, and those of copyright lines alone, match nothing. Equal
canonical forms of two licences would make the lookup ambiguous: the first identifier in
order wins. Rows that repeat a doc_id are rows of their own; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.buffers import documents
from plumbline.llm.licence_texts import NOTICES, SPELLINGS, TEXTS

COPYRIGHT = r"(?m)^[ \t*#/;\-]*(?:portions )?(?:copyright|\(c\)|©|all rights reserved)[^\n]*"
BROADCAST_ROWS = 10_000
NOTICE_ROWS = 1_000


def folded(text: Column) -> Column:
    """Lower case, without copyright lines, punctuation as blanks; lines stay apart."""
    lower = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "\r\n?", "\n")
    return F.regexp_replace(F.regexp_replace(lower, COPYRIGHT, ""), r"[^\p{L}\p{N}\n]+", " ")


def spelled(text: Column) -> Column:
    """One blank between words, equivalent spellings as one."""
    out = F.concat(F.lit(" "), F.btrim(F.regexp_replace(text, r"[ \n]+", " ")), F.lit(" "))
    for old, new in SPELLINGS:
        out = F.replace(out, F.lit(f" {old} "), F.lit(f" {new} "))
    return F.btrim(out)


def known_licences(spark: SparkSession, texts: dict[str, str] | None = None, notices: list[tuple[str, str]] | None = None) -> DataFrame:
    """license_id, whole, digest, length of the known texts (whole) and notices."""
    rows = [(k, True, v) for k, v in (TEXTS if texts is None else texts).items()] + [(k, False, v) for k, v in (NOTICES if notices is None else notices)]
    made = spark.createDataFrame(rows, "license_id string, whole boolean, text string").select("license_id", "whole", spelled(folded(F.col("text"))).alias("text"))
    return made.groupBy("whole", F.sha2("text", 256).alias("digest")).agg(F.min("license_id").alias("license_id"), F.max(F.length("text")).alias("length"))


def scan_licences(docs: DataFrame, known: DataFrame) -> DataFrame:
    """doc_id, license_id (of the entire text), notices (of single lines, in order)."""
    notices = known.where("not whole").limit(NOTICE_ROWS + 1).collect()
    if len(notices) > NOTICE_ROWS:
        raise ValueError(f"at most {NOTICE_ROWS} notices")
    texts = known.where("whole").select(F.col("digest").alias("_whole"), "license_id")
    longest_line = max((r["length"] for r in notices), default=0)
    # Digests of a few thousand texts are known to be small; more are joined as any table.
    texts = F.broadcast(texts) if texts.count() <= BROADCAST_ROWS else texts
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), folded(F.col("text").cast("string")).alias("text"))
    lines = F.filter(F.split("text", "\n"), lambda x: (F.length(x) <= 2 * longest_line) & (F.length(x) > 1))
    units = text.select("doc_id", F.sha2(spelled(F.col("text")), 256).alias("digest"), F.transform(lines, lambda x: F.sha2(spelled(x), 256)).alias("lines"))
    matched = units.join(texts, F.col("digest") == F.col("_whole"), "left")
    # The notices' digests are few: looked up in a literal map, lines need not be joined and gathered again.
    pairs = [F.lit(x) for r in sorted(notices, key=lambda r: r["digest"]) for x in (r["digest"], r["license_id"])]
    names = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    found = F.filter(F.transform("lines", lambda x: F.element_at(names, x)), lambda x: x.isNotNull())
    return matched.select("doc_id", "license_id", found.alias("notices"))


def op8_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licences(documents(spark, sf_dir), known_licences(spark))


def _sql_folded(text: str) -> str:
    lower = f"regexp_replace(lower(coalesce({text}, '')), chr(13) || chr(10) || '?', chr(10), 'g')"
    return f"regexp_replace(regexp_replace({lower}, '{COPYRIGHT}', '', 'g'), '[^\\p{{L}}\\p{{N}}\\n]+', ' ', 'g')"


def _sql_spelled(text: str) -> str:
    out = f"' ' || trim(regexp_replace({text}, '[ \\n]+', ' ', 'g')) || ' '"
    for old, new in SPELLINGS:
        out = f"replace({out}, ' {old} ', ' {new} ')"
    return f"trim({out})"


def _sql_values() -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    return ", ".join([f"({quoted(k)}, true, {quoted(v)})" for k, v in TEXTS.items()] + [f"({quoted(k)}, false, {quoted(v)})" for k, v in NOTICES])


ORACLE_SQL = f"""
WITH t(license_id, whole, text) AS (VALUES {_sql_values()}),
known AS (SELECT whole, digest, min(license_id) AS license_id FROM (SELECT license_id, whole, sha256({_sql_spelled(_sql_folded("text"))}) AS digest FROM t) GROUP BY ALL),
d AS (SELECT row_number() OVER () AS row, doc_id, {_sql_folded("text")} AS text FROM documents),
w AS (SELECT row, doc_id, sha256({_sql_spelled("text")}) AS digest FROM d),
u AS (SELECT row, unnest(str_split(text, chr(10))) AS line, generate_subscripts(str_split(text, chr(10)), 1) AS pos FROM d),
n AS (SELECT row, list(license_id ORDER BY pos) AS notices FROM (SELECT row, pos, sha256({_sql_spelled("line")}) AS digest FROM u WHERE length(line) < 400) JOIN known USING (digest) WHERE NOT whole GROUP BY row)
SELECT w.doc_id, k.license_id, coalesce(n.notices, []) AS notices
FROM w LEFT JOIN (SELECT * FROM known WHERE whole) k USING (digest) LEFT JOIN n USING (row)
"""
