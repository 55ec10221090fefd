"""Line dedup by a log-template tree.

A line is parsed at a fixed depth: by its number of tokens, then by its leading
tokens, where tokens with digits are fields. Within a leaf the positions without
a majority token are further fields; what stays constant is the leaf's template.
A line's template is its leaf's, if that is constant enough and the line fits it,
else the line itself with its fields masked. Lines whose template recurs in
enough documents are dropped everywhere but in the document with the smallest id.
Lines too short or with too many fields for a template recur word for word, and
so do long lines, of which two documents are enough.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, release

FIELD = "<*>"
_SPACE = r"[\x20\x09\x0B-\x0D]+"
_SALTED = 500  # masked lines of a leaf that meet in a task


def _masked(lines: DataFrame) -> DataFrame:
    """(id, line, plain, masked, digits) of (id, line, raw): a line's tokens joined by single spaces, the same with fields masked, and whether it has fields.

    Most lines are both already, which one pattern tells; only those with digits or odd white
    space are taken apart.
    """
    raw = F.col("raw")
    odd = raw.rlike(r"[0-9\t\x0B-\x0D]|\x20\x20") | raw.startswith(" ") | raw.endswith(" ")
    words = F.filter(F.split("raw", _SPACE), lambda t: t != "")
    masked = F.concat_ws(" ", F.transform(words, lambda t: F.when(t.rlike("[0-9]"), F.lit(FIELD)).otherwise(t)))
    told = lines.withColumn("odd", odd)
    return told.select("id", "line", F.when(F.col("odd"), F.concat_ws(" ", words)).otherwise(raw).alias("plain"), F.when(F.col("odd"), masked).otherwise(raw).alias("masked"), F.when(F.col("odd"), raw.rlike("[0-9]")).otherwise(False).alias("digits"))


def _keyed_lines(df: DataFrame, id_col: str, text_col: str, least: int, leading: int, constant: float, long: int, min_docs: int) -> DataFrame:
    """(id, line, masked, n, k1, k2, leaf, r1, r2, need): the lines that aren't blank.

    k1 and k2 identify the masked line; they and leaf are null for lines below ``least``
    tokens or with more than 1 - ``constant`` fields. r1 and r2 identify the line itself, where
    recurring word for word differs from recurring by template; need is in how many documents.
    """
    lines = df.select(F.col(id_col).cast("long").alias("id"), F.posexplode(F.split(F.col(text_col), "\n")).alias("line", "raw"))
    cut = _masked(lines).where("masked <> ''")
    n = F.octet_length("masked") - F.octet_length(F.replace("masked", F.lit(" "), F.lit(""))) + 1
    fields = F.octet_length("masked") - F.octet_length(F.replace("masked", F.lit(FIELD), F.lit("")))  # three bytes each
    counted = cut.withColumn("n", n).withColumn("able", (F.col("n") >= least) & (100 * fields <= 3 * round(100 * (1 - constant)) * F.col("n")))
    exact = F.col("digits") | (F.col("n") >= long) | ~F.col("able")
    when = lambda c, x: F.when(F.col(c) if isinstance(c, str) else c, x)
    return counted.select(
        "id", "line", "masked", "n", when("able", F.xxhash64("masked")).alias("k1"), when("able", F.xxhash64(F.lit("2"), "masked")).alias("k2"),
        when("able", F.xxhash64("n", F.substring_index("masked", " ", leading))).alias("leaf"),
        when(exact, F.xxhash64("plain")).alias("r1"), when(exact, F.xxhash64(F.lit("2"), "plain")).alias("r2"), F.when(F.col("n") >= long, min(2, min_docs)).otherwise(min_docs).alias("need"),
    )


def dropped_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 3, leading: int = 3, constant: float = 0.7, min_docs: int = 3, long: int = 50) -> DataFrame:
    """(id, line): 0-based lines to drop, some of them twice.

    A line goes if its template recurs in ``min_docs`` documents, or if it recurs word for
    word in as many, whatever its length and fields, or in two if it has ``long`` words or
    more; white space counts as one space. Rows that share an id count as one document;
    lines of rows without id count but are never dropped. Null texts have no lines.
    """
    seen = _keyed_lines(df, id_col, text_col, least, leading, constant, long, min_docs)
    lines = materialize(seen.drop("masked"), "lines")
    able = lines.where("k1 IS NOT NULL")
    by_doc = able.groupBy("k1", "k2", "leaf", "n", "id").agg(F.lit(1).alias("one"))
    distinct = materialize(by_doc.groupBy("k1", "k2", "leaf", "n").agg(F.count("*").alias("docs"), F.min("id").alias("first"), F.max("id").alias("last")), "masked")
    leaves = distinct.groupBy("leaf").agg(F.count("*").alias("kinds"), F.sum("docs").alias("total"), F.min("first").alias("first"), F.max("last").alias("last"))
    leaves = leaves.where((F.col("kinds") > 1) & (F.col("total") >= min_docs) & (F.col("first") < F.col("last")))
    leaves = materialize(leaves.select("leaf", "total", F.ceil(F.col("kinds") / _SALTED).cast("int").alias("salts")), "leaves")
    # One row for each masked line of a leaf that may generalise; a large leaf's are dealt to several salts.
    shown = seen.where("leaf IS NOT NULL").select("k1", "k2", "leaf", "masked").join(leaves.select("leaf", "salts"), "leaf").groupBy("k1", "k2", "leaf", "salts").agg(F.first("masked").alias("masked"))
    shown = shown.select("k1", "k2", "leaf", F.pmod("k1", "salts").cast("int").alias("salt"), F.split("masked", " ").alias("toks"))
    shown = materialize(shown.join(distinct.select("k1", "k2", "docs"), ["k1", "k2"]), "shown")
    votes = shown.select("leaf", "docs", F.posexplode("toks").alias("pos", "tok")).groupBy("leaf", "pos", "tok").agg(F.sum("docs").alias("docs"))
    most = votes.groupBy("leaf", "pos").agg(F.max(F.struct("docs", "tok")).alias("top"))
    fixed = most.join(leaves, "leaf").where("2 * top.docs > total").groupBy("leaf", "salts").agg(F.array_sort(F.collect_list(F.struct("pos", F.col("top.tok").alias("tok")))).alias("fixed"))
    fixed = fixed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    fits = (F.size("fixed") >= F.lit(constant) * F.size("toks")) & F.forall("fixed", lambda p: F.col("toks")[p.pos] == p.tok)
    general = shown.join(fixed, ["leaf", "salt"]).where(fits).select("k1", "k2", F.lit(True).alias("general"))
    known = distinct.join(general, ["k1", "k2"], "left")
    # A template: the leaf for lines that fit it, else the masked line.
    template = [F.when(F.col("general"), F.col("leaf")).otherwise(F.col("k1")).alias("t1"), F.when(F.col("general"), F.lit(None)).otherwise(F.col("k2")).alias("t2")]
    known = materialize(known.select("k1", "k2", "docs", "first", "last", *template), "templates")
    often = known.groupBy("t1", "t2").agg(F.sum("docs").alias("docs"), F.min("first").alias("keep"), F.max("last").alias("last"))
    often = often.where((F.col("docs") >= min_docs) & (F.col("keep") < F.col("last"))).select("t1", "t2", "keep")
    recurring = known.join(often, (known.t1 == often.t1) & known.t2.eqNullSafe(often.t2)).select("k1", "k2", "keep")
    by_template = able.select("id", "line", "k1", "k2").join(recurring, ["k1", "k2"]).where("id <> keep").select("id", "line")
    # word for word
    exact = lines.where("r1 IS NOT NULL").select("id", "line", "r1", "r2", "need")
    by_doc = exact.groupBy("r1", "r2", "need", "id").agg(F.lit(1).alias("one"))
    again = by_doc.groupBy("r1", "r2", "need").agg(F.count("*").alias("docs"), F.min("id").alias("keep"), F.max("id").alias("last"))
    again = again.where("docs >= need AND keep < last").select("r1", "r2", "keep")
    release(shown)
    return by_template.unionByName(exact.join(again, ["r1", "r2"]).where("id <> keep").select("id", "line"))


def _cut(df: DataFrame, id_col: str, text_col: str, **options) -> DataFrame:
    """(row, n, gone, text): each row as a struct, its number of lines, the lines to drop in order, and the text without them.

    The text is shuffled once, by id. What stays is put together from the slices
    between dropped lines, so the work grows with the lines.
    """
    gone = dropped_lines(df, id_col, text_col, **options).groupBy(F.col("id").alias("gone_id")).agg(F.array_sort(F.collect_set("line")).alias("gone"))
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))
    joined = rows.join(gone, F.col("row")[id_col].cast("long") == F.col("gone_id"), "left").select("row", "gone")
    text = F.col("row")[text_col]
    n = F.when(text.isNull(), 0).otherwise(F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1)
    counted = joined.select("row", n.cast("int").alias("n"), "gone")
    own = F.coalesce(F.filter("gone", lambda k: k < F.col("n")), F.array().cast("array<int>"))

    def kept(s: Column) -> Column:
        start = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(s.gone, i - 1) + 1)
        end = lambda i: F.coalesce(F.get(s.gone, i), F.size(s.lines))
        return F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size(s.gone)), lambda i: F.slice(s.lines, start(i) + 1, end(i) - start(i)))), "\n")

    cut = F.transform(F.array(F.struct(F.split(text, "\n").alias("lines"), F.col("gone"))), kept)[0]
    listed = counted.select("row", "n", own.alias("gone"))
    return listed.select("row", "n", "gone", F.when(F.size("gone") > 0, cut).otherwise(text).alias("text"))


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Rows of ``df`` with the recurring lines taken out of the text; other columns, whatever their names, stay as they are.

    Null texts stay null, a text that loses all its lines is empty, an empty table stays empty.
    """
    cut = _cut(df, id_col, text_col, **options)
    return cut.select(*[F.col("text").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in df.columns])


def report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(id, n_lines, n_dropped, kept_text) for each row; the counts of a null text are 0."""
    cut = _cut(df.select(id_col, text_col), id_col, text_col, **options)
    return cut.select(F.col("row")[id_col].alias(id_col), F.col("n").cast("long").alias("n_lines"), F.size("gone").cast("long").alias("n_dropped"), F.col("text").alias("kept_text"))


# The query's SQL.
SQL = r"""
WITH l AS MATERIALIZED (
  SELECT doc_id, k - 1 AS line, words, list_transform(words, lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END) AS toks
  FROM (SELECT doc_id, k, list_filter(regexp_split_to_array(raw, '[\x20\x09\x0B-\x0D]+'), lambda x: x <> '') AS words FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents))),
m AS MATERIALIZED (SELECT toks, len(toks) AS n, toks[1:3] AS head, count(DISTINCT doc_id) AS docs, min(doc_id) AS lo, max(doc_id) AS hi FROM l WHERE len(toks) >= 3
  AND 100 * (length(array_to_string(toks, ' ')) - length(replace(array_to_string(toks, ' '), '<*>', ''))) <= 90 * len(toks) GROUP BY toks),
v AS MATERIALIZED (SELECT n, head, sum(docs) AS total FROM m GROUP BY n, head HAVING count(*) > 1 AND sum(docs) >= 3 AND min(lo) < max(hi)),
f AS MATERIALIZED (SELECT n, head, list(pos) AS pos, list(tok) AS tok FROM (
    SELECT n, head, pos, tok FROM (SELECT m.n, m.head, m.docs, unnest(toks) AS tok, generate_subscripts(toks, 1) AS pos FROM m SEMI JOIN v ON m.n = v.n AND m.head = v.head)
    JOIN v USING (n, head) GROUP BY n, head, pos, tok, total HAVING 2 * sum(docs) > total) GROUP BY n, head),
k AS MATERIALIZED (SELECT m.*, coalesce(len(f.pos) >= 0.7 * m.n AND len(list_filter(list_zip(f.pos, f.tok), lambda x: m.toks[x[1]] <> x[2])) = 0, false) AS general
  FROM m LEFT JOIN f ON m.n = f.n AND m.head = f.head),
r AS MATERIALIZED (SELECT toks, min(lo) OVER w AS keep, max(hi) OVER w AS hi, sum(docs) OVER w AS docs FROM k
  WINDOW w AS (PARTITION BY n, head, general, CASE WHEN general THEN NULL ELSE toks END)),
w AS MATERIALIZED (SELECT words, min(doc_id) AS keep FROM l WHERE len(words) > 0 GROUP BY words HAVING count(DISTINCT doc_id) >= CASE WHEN len(words) >= 50 THEN 2 ELSE 3 END),
d AS (SELECT doc_id, list(DISTINCT line) AS gone FROM (SELECT l.doc_id, l.line FROM l JOIN r ON l.toks = r.toks WHERE r.docs >= 3 AND r.keep < r.hi AND l.doc_id <> r.keep
  UNION ALL SELECT l.doc_id, l.line FROM l JOIN w ON l.words = w.words WHERE l.doc_id <> w.keep) GROUP BY doc_id)
SELECT doc_id, coalesce(len(string_split(text, chr(10))), 0)::BIGINT AS n_lines, coalesce(len(gone), 0)::BIGINT AS n_dropped,
  CASE WHEN gone IS NULL THEN text ELSE coalesce(array_to_string(list_filter(string_split(text, chr(10)), lambda x, i: NOT list_contains(gone, i - 1)), chr(10)), '') END AS kept_text
FROM documents LEFT JOIN d USING (doc_id)
"""
