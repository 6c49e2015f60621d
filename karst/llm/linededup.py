"""Removal of repeated multi-line chunks, with DataFrame functions alone.

A line's hash is the first 32 bits of its MD5. A rolling hash over WINDOW lines, (h[i-1] * 31 + h[i]) mod MODULUS, ends a
chunk where it is smaller than the one before and no larger than the one after; so boundaries depend on nearby lines only,
shift with them, and never lie one line apart. A line of over LONE words is a chunk of its own, and no low point leaves
another line alone beside it or at a text's end (a short line between two lone ones is alone, and stays). A chunk of two lines or more, of LEAST characters or more, or a lone line
of over LONE words, that occurs more than once in the corpus is kept where (doc_id, place) is smallest. Elsewhere it is
removed if its bytes equal those of the kept one.

Only hashes and places of chunks are grouped; the kept chunks' texts are then fetched and joined to the other places.
A chunk that a third of all documents share is one row on one side of a join that adaptive execution may split.

Cases: null texts stay null and empty ones empty; a text all of whose chunks are repeated becomes empty, its row stays;
rows with a null doc_id take no part and stay as they are; repeated rows of one doc_id and text are treated alike;
different texts of one id are documents apart, and a chunk that both hold first at one place stays in both; an empty
table gives no rows; all other columns, whatever their names, are passed on by `remove`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW, MODULUS, LEAST, LONE = 2, 1_000_003, 20, 50

_LINES = "split(text, '\n', -1)"


def _lone(line: str) -> str:
    """Whether a line has over LONE words, which takes more than 2 * LONE characters."""
    return f"(length({line}) > {2 * LONE} and regexp_count({line}, '[^\\\\x20\\\\x09-\\\\x0D]+') > {LONE})"


_HASH = f"transform(_lines, l -> named_struct('h', cast(conv(substring(md5(l), 1, 8), 16, 10) as bigint), 'lone', {_lone('l')}))"
_ROLL = f"transform(_h, (x, i) -> pmod(if(i = 0, 0, get(_h, i - 1).h) * 31 + x.h, {MODULUS}))"
_LOW = "i > 0 and i < size(_h) - 2 and get(_r, i) < get(_r, i - 1) and get(_r, i) <= get(_r, i + 1)"
_ENDS = f"""filter(sequence(0, size(_h) - 1), i -> i = size(_h) - 1 or get(_h, i).lone or get(_h, i + 1).lone
    or ({_LOW} and not get(_h, i - 1).lone and not get(_h, i + 2).lone))"""


def _chunk(k: str) -> str:
    """The text of chunk k."""
    start = f"if({k} = 0, 0, _ends[greatest({k}, 1) - 1] + 1)"
    return f"array_join(slice(_lines, {start} + 1, _ends[{k}] - {start} + 1), '\n')"


def chunked(docs: DataFrame) -> DataFrame:
    """Adds the lines and the last line of each chunk, as _lines and _ends. The caller's columns are out of reach here: `_parted`."""
    hashed = docs.withColumn("_lines", F.expr(_LINES)).withColumn("_h", F.expr(_HASH)).withColumn("_r", F.expr(_ROLL))
    return hashed.withColumn("_ends", F.expr(_ENDS)).drop("_h", "_r")


def _places(docs: DataFrame) -> DataFrame:
    """(doc_id, h, k, key) of the chunks that may be removed; h tells apart the texts of one id."""
    size = "_ends[k] - if(k = 0, -1, _ends[greatest(k, 1) - 1])"
    some = f"filter(sequence(0, size(_ends) - 1), k -> if({size} > 1, length({_chunk('k')}) >= {LEAST}, {_lone('_lines[_ends[k]]')}))"
    keyed = f"transform({some}, k -> named_struct('k', k, 'key', xxhash64({_chunk('k')})))"
    rows = chunked(docs.where("doc_id is not null and text is not null")).select("doc_id", "h", F.explode(F.expr(keyed)).alias("c"))
    return rows.select("doc_id", "h", "c.k", "c.key")


def remove(docs: DataFrame) -> DataFrame:
    """documents (doc_id, text, ...) -> the same columns with repeated chunks taken out of text, and n_chunks, n_removed,
    which replace columns of these names."""
    kept = [c for c in docs.columns if c not in ("n_chunks", "n_removed")]
    return removed(docs.select(*(F.col(f"`{c}`") for c in kept)), kept, True)


def removed(docs: DataFrame, columns: list[str], counted: bool = False) -> DataFrame:
    """The given columns of documents with repeated chunks taken out of text; counted adds n_chunks and n_removed."""
    # the caller's other columns travel as one, so no name can clash
    rest = [c for c in columns if c not in ("doc_id", "text")]
    h = F.xxhash64("text").alias("h")
    packed = docs.select("doc_id", "text", h, *([F.struct(*(F.col(f"`{c}`") for c in rest)).alias("row")] if rest else []))
    own = docs.select("doc_id", "text", h)
    places = _places(own)
    # what is gathered for a row is a list of its own text's chunks, however many rows share its id or its text
    first = places.groupBy("key").agg(F.min(F.struct("doc_id", "k", "h")).alias("f"), F.max(F.struct("doc_id", "k")).alias("l")).where("struct(f.doc_id, f.k) < l").select("key", "f")
    wanted = first.groupBy(F.col("f.doc_id").alias("doc_id"), F.col("f.h").alias("h")).agg(F.collect_list(F.struct(F.col("f.k").alias("k"), "key")).alias("_want"))
    held = chunked(own.join(wanted, ["doc_id", "h"])).withColumn("w", F.explode("_want")).where("w.k < size(_ends)").select("w.key", F.expr(_chunk("w.k")).alias("kept"))
    held = held.where("xxhash64(kept) = key").groupBy("key").agg(F.min("kept").alias("kept"))
    others = places.join(first, "key").where("struct(doc_id, k) <> struct(f.doc_id, f.k)").select("key", "doc_id", "h", "k")
    marks = others.join(held, "key").groupBy("doc_id", "h").agg(F.collect_set(F.struct("k", "kept")).alias("_marks"))
    joined = chunked(packed.join(marks, ["doc_id", "h"], "left"))
    gone = F.expr(f"transform(filter(coalesce(_marks, array()), m -> m.k < size(_ends) and {_chunk('m.k')} = m.kept), m -> m.k)")
    joined = joined.withColumn("_gone", F.array_distinct(gone))
    rest_of = F.expr(f"array_join(transform(array_except(sequence(0, size(_ends) - 1), _gone), k -> {_chunk('k')}), '\n')")
    text = F.when(F.size("_gone") > 0, rest_of).otherwise(F.col("text"))
    out: list[Column] = [text.alias("text") if c == "text" else F.col("doc_id") if c == "doc_id" else F.col("row").getField(c).alias(c) for c in columns]
    if counted:
        out += [F.when(F.col("text").isNull(), 0).otherwise(F.size("_ends")).cast("long").alias("n_chunks"), F.size("_gone").cast("long").alias("n_removed")]
    return joined.select(*out)


ORACLE = rf"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i,
         len(string_split(text, chr(10))) AS n
  FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
hashed AS (
  SELECT *, ('0x' || substr(md5(line), 1, 8))::BIGINT AS h, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) > {LONE} AS lone
  FROM lines),
rolled AS (
  SELECT *, (coalesce(lag(h) OVER w, 0) * 31 + h) % {MODULUS} AS r FROM hashed WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
marked AS (
  SELECT *, CASE WHEN i = n - 1 OR lone OR lead(lone) OVER w
                   OR (i > 0 AND i < n - 2 AND r < lag(r) OVER w AND r <= lead(r) OVER w
                       AND NOT lag(lone) OVER w AND NOT lead(lone, 2) OVER w) THEN 1 ELSE 0 END AS last
  FROM rolled WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
numbered AS (
  SELECT *, coalesce(sum(last) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM marked),
chunks AS (
  SELECT doc_id, k, string_agg(line, chr(10) ORDER BY i) AS chunk, count(*) AS size, bool_or(lone) AS lone FROM numbered GROUP BY doc_id, k),
ranked AS (
  SELECT *, (lone OR size > 1 AND length(chunk) >= {LEAST})
         AND row_number() OVER (PARTITION BY chunk, size ORDER BY doc_id, k) > 1 AS gone FROM chunks),
rebuilt AS (
  SELECT doc_id, coalesce(string_agg(chunk, chr(10) ORDER BY k) FILTER (WHERE NOT gone), '') AS text,
         count(*) AS n_chunks, count(*) FILTER (WHERE gone) AS n_removed
  FROM ranked GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN r.doc_id IS NULL THEN d.text ELSE r.text END AS text,
       coalesce(r.n_chunks, 0) AS n_chunks, coalesce(r.n_removed, 0) AS n_removed
FROM documents d LEFT JOIN rebuilt r ON d.doc_id = r.doc_id
"""
