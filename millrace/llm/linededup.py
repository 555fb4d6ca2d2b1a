"""Removal of passages that repeat across a corpus, by three-line windows.

Every three consecutive lines of a text form a window, and windows overlap. A
text of fewer lines forms one window of all of them, and a line of over fifty
words is a window of its own as well, as a passage may be one line.
Equal windows are found globally by a 128-bit hash; the first occurrence (by
id, then line number) stays and the lines that later occurrences cover are
removed, overlapping windows being merged. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.tables import free_names, load
from millrace.scratch import materialize

WINDOW = 3
#: A line that holds this many blanks is a window of its own.
LONG_LINE_BLANKS = 50


def _windows() -> Column:
    """Structs of place, length and two hashes of the windows of the lines ``ls``."""

    def window(at: str, size: int) -> str:
        lines = [f"ls[{at} + {k}]" for k in range(size)]
        blank = " and ".join(f"trim({x}) = ''" for x in lines)
        hashes = f"'a', xxhash64({', '.join(lines)}), 'b', xxhash64('second', {', '.join(lines)})"
        return f"if({blank}, null, named_struct('pos', {at}, 'len', {size}, {hashes}))"

    whole = f"if(size(ls) >= {WINDOW}, transform(sequence(0, size(ls) - {WINDOW}), i -> {window('i', WINDOW)}), array())"
    short = "case " + " ".join(f"when size(ls) = {n} then array({window('0', n)})" for n in range(1, WINDOW)) + " else array() end"
    blanks = "octet_length(ls[i]) - octet_length(replace(ls[i], ' ', ''))"
    long = f"transform(sequence(0, size(ls) - 1), i -> if({blanks} >= {LONG_LINE_BLANKS}, {window('i', 1)}, null))"
    return F.expr(f"array_compact(concat({whole}, {short}, if(size(ls) > 1, {long}, array())))")


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lines_col: str = "n_lines", removed_col: str = "n_removed"
) -> DataFrame:
    """``docs`` with ``text`` cleaned, plus ``n_lines`` and ``n_removed`` (or the
    names given, which replace columns of these names).

    Lines are the parts between newlines. Windows of blank lines only do not
    count. Where a later occurrence overlaps the first one in the same text,
    the lines of the first stay. A null text stays null with no lines. Of the
    texts of one id that of the smaller hash comes first. Rows that agree in id
    and text are one text and are treated alike; a null id sorts first.
    """
    source = docs.drop(lines_col, removed_col)
    key, lines_at, gone_at, own_id, own_h = free_names(source, "key", "lines", "gone", "own_id", "own_h")
    keyed = source.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"), F.split(text_col, "\n", -1).alias("ls"))
    windows = materialize(
        keyed.where("ls is not null").select("id", "h", F.explode(_windows()).alias("w")).select("id", "h", "w.pos", "w.len", "w.a", "w.b")
    )
    place = F.struct("id", "h", "pos")
    repeated = (
        windows.groupBy("len", "a", "b")
        .agg(F.count("*").alias("n"), F.min(place).alias("first"))
        .where("n > 1")
        .select("len", "a", "b", "first")
    )
    same_text = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("h") == F.col("first.h"))
    later = windows.join(repeated, ["len", "a", "b"]).where(~(same_text & (F.col("pos") == F.col("first.pos"))))
    begin = F.when(same_text, F.greatest("pos", F.col("first.pos") + F.col("len"))).otherwise(F.col("pos"))
    covered = (
        later.select("id", "h", begin.alias("begin"), (F.col("pos") + F.col("len") - 1).alias("end"))
        .where("begin <= end")
        .groupBy("id", "h")
        .agg(F.flatten(F.collect_set(F.sequence("begin", "end"))).alias("gone"))
        .select(F.col("id").alias(own_id), F.col("h").alias(own_h), F.array_distinct("gone").alias(gone_at))
    )
    marked = source.withColumn(key, F.xxhash64(text_col)).join(
        covered, F.col(id_col).eqNullSafe(F.col(own_id)) & (F.col(key) == F.col(own_h)), "left"
    )
    gone = F.col(gone_at)
    kept = F.expr(f"transform(array_except(sequence(0, size({lines_at}) - 1), {gone_at}), i -> {lines_at}[i])")
    cleaned = F.when(gone.isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n"))
    return marked.withColumn(lines_at, F.split(text_col, "\n", -1)).select(
        *[cleaned.alias(c) if c == text_col else F.col(c) for c in source.columns],
        F.when(F.col(text_col).isNull(), F.lit(0)).otherwise(F.size(lines_at)).cast("long").alias(lines_col),
        F.coalesce(F.size(gone), F.lit(0)).cast("long").alias(removed_col),
    )


def op9_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the passages that occur earlier in the corpus."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs)


OP9_SQL = f"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
w AS (
  SELECT doc_id, i - 1 AS pos, 3 AS size, ls[i] AS a, ls[i + 1] AS b, ls[i + 2] AS c
  FROM (SELECT doc_id, ls, unnest(range(1, len(ls) - 1)) AS i FROM d)
  UNION ALL SELECT doc_id, 0, len(ls), ls[1], ls[2], NULL FROM d WHERE len(ls) < 3
  UNION ALL
  SELECT doc_id, i - 1, 1, ls[i], NULL, NULL FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM d WHERE len(ls) > 1)
  WHERE strlen(ls[i]) - strlen(replace(ls[i], ' ', '')) >= {LONG_LINE_BLANKS}
),
o AS (
  SELECT doc_id, pos, size, first_value(doc_id) OVER p AS fd, first_value(pos) OVER p AS fp
  FROM w WHERE NOT (trim(a) = '' AND trim(coalesce(b, '')) = '' AND trim(coalesce(c, '')) = '')
  WINDOW p AS (PARTITION BY size, a, b, c ORDER BY doc_id, pos)
),
gone AS (
  SELECT DISTINCT doc_id,
    unnest(range(CASE WHEN doc_id = fd THEN greatest(pos, fp + size) ELSE pos END, pos + size)) AS pos
  FROM o WHERE NOT (doc_id = fd AND pos = fp)
),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS pos FROM d),
k AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS text
  FROM l ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id
)
SELECT d.doc_id, coalesce(k.text, CASE WHEN d.text IS NOT NULL THEN '' END) AS text,
  CAST(coalesce(len(d.ls), 0) AS BIGINT) AS n_lines,
  CAST(coalesce(g.n, 0) AS BIGINT) AS n_removed
FROM d LEFT JOIN k USING (doc_id)
LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id) g USING (doc_id)
"""
