"""Removal of lines that many sites share.

A line's spread is the number of distinct sites whose documents hold it. One HyperLogLog sketch
of sites per line hash is built map-side and merged by the aggregation. Lines whose estimate is
near the threshold get an exact distinct count; the others are decided by the sketch. Of a line
that is spread widely, the first occurrence (smallest document, then line number) stays, so that
the content of a group of copies is kept once; all others go.

DataFrame functions only: a hot line meets in partial aggregates, and a document is put together
again from its own row, so no line's or site's rows gather anywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import stored

#: Distinct sites from which a line counts as boilerplate.
MIN_SITES = 10
#: Characters, without surrounding white space, that a line must have at least: all lines but blank ones.
MIN_CHARS = 1
#: Sketch estimates within this share of the threshold are counted exactly.
NEAR = 0.5
#: Log2 of the sketch's registers: a relative error of about 2.3 per cent.
LG_K = 11


def _line_key(line: Column) -> list[Column]:
    return [F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(7), line, F.length(line)).alias("h2")]


def _row_key(doc: Column, site: Column, text: Column) -> Column:
    """Rows with equal keys are equal in document, site and text."""
    return F.struct(F.xxhash64(doc, site, text).alias("a"), F.xxhash64(F.lit(7), doc, text, site).alias("b"))


def spread_lines(lines: DataFrame, min_sites: int, near: float) -> DataFrame:
    """(h1, h2, first) of the lines on at least min_sites sites; lines: h1, h2, site, at."""
    sketched = lines.groupBy("h1", "h2").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LG_K))).alias("estimate"), F.count(F.lit(1)).alias("n"), F.min("at").alias("first")
    )
    # a line cannot be on more sites than it has occurrences
    sketched = stored(sketched.filter((F.col("estimate") >= min_sites * (1 - near)) & (F.col("n") >= min_sites)).drop("n"), "line-sketches")
    close = sketched.filter(F.col("estimate") < min_sites * (1 + near)).select("h1", "h2")
    exact = (
        lines.select("h1", "h2", "site").join(close, ["h1", "h2"], "left_semi").distinct()
        .groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("sites")).filter(F.col("sites") >= min_sites).select("h1", "h2")
    )
    sure = sketched.filter(F.col("estimate") >= min_sites * (1 + near))
    return sure.select("h1", "h2", "first").unionByName(sketched.join(exact, ["h1", "h2"], "left_semi").select("h1", "h2", "first"))


def drop_spread_lines(
    docs: DataFrame, *, doc: str = "doc_id", site: str = "source", text: str = "text",
    min_sites: int = MIN_SITES, min_chars: int = MIN_CHARS, near: float = NEAR,
) -> DataFrame:
    """docs with the text of the remaining lines, and n_lines_dropped; every row stays.

    A null site is no site: its lines are dropped if spread elsewhere, but add nothing to a
    spread. A null or empty text stays as it is. A null document sorts before all others when
    the first occurrence is chosen; rows that are equal in document and text keep or lose the
    same lines. Lines are compared exactly, but for surrounding white space; those shorter than
    min_chars are never dropped. All other columns stay; one named n_lines_dropped is replaced.
    """
    kept = [c for c in docs.columns if c != "n_lines_dropped"]
    rows = docs.select(*[F.col(f"`{c}`") for c in kept])
    lines = (
        rows.filter(F.col(text).isNotNull())
        .select(
            F.col(doc).alias("doc"), F.col(site).cast("string").alias("site"), _row_key(F.col(doc), F.col(site), F.col(text)).alias("row"),
            F.posexplode(F.split(F.col(text), "\n")).alias("pos", "line"),
        )
        .withColumn("line", F.trim(F.col("line"))).filter(F.length("line") >= min_chars)
        .select("row", "pos", "site", F.struct("doc", "pos").alias("at"), *_line_key(F.col("line")))
    )
    # without sites the sketch of a line is empty: 0 sites
    spread = stored(spread_lines(lines.filter(F.col("site").isNotNull()), min_sites, near), "spread-lines")
    dropped = (
        lines.select("row", "pos", "at", "h1", "h2").join(spread, ["h1", "h2"])
        .filter(~F.col("at").eqNullSafe(F.col("first"))).groupBy(F.col("row").alias("__row")).agg(F.collect_set("pos").alias("__gone"))
    )
    marked = rows.withColumn("__row", _row_key(F.col(doc), F.col(site), F.col(text))).join(dropped, "__row", "left")
    kept_lines = F.filter(F.split(F.col(text), "\n"), lambda _, i: ~F.array_contains(F.col("__gone"), i))
    new_text = F.when(F.col("__gone").isNull(), F.col(text)).otherwise(F.array_join(kept_lines, "\n"))
    out = [new_text.alias(text) if c == text else F.col(f"`{c}`") for c in kept]
    return marked.select(*out, F.coalesce(F.size("__gone"), F.lit(0)).cast("int").alias("n_lines_dropped"))


def oracle(min_sites: int = MIN_SITES, min_chars: int = MIN_CHARS) -> str:
    """The same as DuckDB SQL over documents: doc_id, text, n_lines_dropped."""
    return f"""
        with parts as (select doc_id, source, string_split(text, chr(10)) as l from documents where text is not null),
        lines as (select doc_id, source, unnest(range(len(l))) as pos, trim(unnest(l)) as line from parts),
        spread as (
            select line, min(struct_pack(d := doc_id, p := pos)) as f from lines where length(line) >= {min_chars}
            group by line having count(distinct source) >= {min_sites}),
        gone as (select doc_id, list(distinct pos) as ps from lines join spread using (line) where not (doc_id = f.d and pos = f.p) group by doc_id)
        select d.doc_id, case when ps is null then text else coalesce(array_to_string(
            [x[2] for x in list_zip(range(len(string_split(text, chr(10)))), string_split(text, chr(10))) if not list_contains(ps, x[1])], chr(10)), '') end as text,
            cast(coalesce(len(ps), 0) as integer) as n_lines_dropped
        from documents d left join gone using (doc_id)"""
