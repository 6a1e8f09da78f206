"""Article texts of web pages by site template removal.

Every page is read into blocks of text and element subtrees. The hashes of the subtrees are counted for each host in Spark, over pages of
different text; subtrees that recur on many pages of their host are its template and go, with what they hold. Markup that says itself that it
is no article text (menus, forms, scripts, comments and so on; ``markup.py``) goes before, whatever the counts.

Subtrees outside an article element need ``loose`` = (pages, share of the host's pages) to be template; prose, parts of an article and what holds
over half of a page's text need ``strict``, so that copies of an article and passages that articles share stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textwarden.llm.markup import Page
from textwarden.llm.tables import keep

#: Least number of pages of different text, and share of the host's pages, on which template subtrees recur.
LOOSE, STRICT = (3, 0.05), (8, 0.8)
#: Templates (of all hosts, 17 bytes each) that are broadcast at most; more are joined by a shuffle, a frequent subtree's rows in SALT parts.
BROADCAST, SALT = 1_000_000, 16


def host(url: Column) -> Column:
    """Host of a URL in lower case, without user, port and final dot; null where there is none."""
    found = F.lower(F.regexp_extract(url, r"^\s*(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:\s]+)", 1))
    return F.nullif(F.regexp_replace(found, r"\.$", ""), F.lit(""))


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def _signs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per page: hashes of its markup and of its text, and its subtrees, each once."""
    for batch in batches:
        name, text, subtrees = [], [], []
        for html in batch.column("html").to_pylist():
            _, found, whole = Page(html).blocks()
            name.append(_signed(xxhash.xxh3_64_intdigest(html.encode())))
            text.append(_signed(xxhash.xxh3_64_intdigest(whole.encode("utf-8", "surrogatepass"))))
            subtrees.append([{"hash": h, "strict": s} for h, s in {h: s for h, _, _, s in found}.items()])
        kind = pa.list_(pa.struct([("hash", pa.int64()), ("strict", pa.bool_())]))
        yield pa.RecordBatch.from_arrays([batch.column("site"), pa.array(name, pa.int64()), pa.array(text, pa.int64()), pa.array(subtrees, kind)], ["site", "name", "text", "subtrees"])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        name, blocks, hashes, firsts, ends = [], [], [], [], []
        for html in batch.column("html").to_pylist():
            texts, found, _ = Page(html or "").blocks()
            name.append(_signed(xxhash.xxh3_64_intdigest((html or "").encode())))
            # Lone surrogates, which character references can spell, are no text.
            blocks.append([t.encode("utf-8", "replace").decode() for t in texts])
            hashes.append([s[0] for s in found])
            firsts.append([s[1] for s in found])
            ends.append([s[2] for s in found])
        spans = [pa.array(hashes, pa.list_(pa.int64())), pa.array(firsts, pa.list_(pa.int32())), pa.array(ends, pa.list_(pa.int32()))]
        columns = [batch.column("row"), batch.column("site"), pa.array(name, pa.int64()), pa.array(blocks, pa.list_(pa.string())), *spans]
        yield pa.RecordBatch.from_arrays(columns, ["row", "site", "name", "blocks", "hashes", "firsts", "ends"])


def site_templates(signs: DataFrame, loose: tuple[int, float] = LOOSE, strict: tuple[int, float] = STRICT) -> DataFrame:
    """(site, hash, always): subtrees that recur on many pages of different text of their site; ``always`` if they meet ``strict``."""
    pages = signs.groupBy("site", "text").agg(F.lit(1).alias("_")).groupBy("site").agg(F.count("*").alias("pages"))
    counted = signs.select("site", F.explode("subtrees.hash").alias("hash"), "text").distinct().groupBy("site", "hash").agg(F.count("*").alias("n")).where(F.col("n") >= min(loose[0], strict[0]))
    many = lambda bound: (F.col("n") >= bound[0]) & (F.col("n") >= bound[1] * F.col("pages"))
    return counted.join(pages, "site").where(many(loose) | many(strict)).select("site", "hash", many(strict).alias("always"))


def extract_articles(pages: DataFrame, url_col: str = "url", html_col: str = "html", loose: tuple[int, float] = LOOSE, strict: tuple[int, float] = STRICT) -> DataFrame:
    """(row, text, n_chars, n_template): row holds the columns of ``pages`` as they were, n_template the template subtrees that were deleted.

    The text is the blocks in page order joined by a line feed, empty where there is none; character references are decoded and white space
    in a block is one space. Null, empty and blank pages have an empty text. Pages whose URL is null or has no host are read, but
    belong to no site, so nothing of them is template. Repeated rows stay rows, and copies count as one page. An empty table gives an empty result.
    """
    site = F.xxhash64(host(F.col(url_col)))
    known = pages.where(host(F.col(url_col)).isNotNull() & F.col(html_col).isNotNull()).select(site.alias("site"), F.col(html_col).alias("html"))
    signs = keep(known.mapInArrow(_signs, "site long, name long, text long, subtrees array<struct<hash: long, strict: boolean>>"), "subtrees")
    once = signs.groupBy("site", "name").agg(F.first("subtrees").alias("subtrees")).select("site", "name", F.inline("subtrees"))
    found = keep(site_templates(signs, loose, strict), "templates")
    if found.limit(BROADCAST + 1).count() <= BROADCAST:
        met = once.join(F.broadcast(found), ["site", "hash"])
    else:
        parts = found.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALT - 1).cast("long"))))
        met = once.withColumn("salt", F.pmod("name", F.lit(SALT))).join(parts, ["site", "hash", "salt"])
    hits = met.where("always or not strict").groupBy("site", "name").agg(F.collect_set("hash").alias("template"))

    row = F.struct(*(c for c in pages.columns if c != html_col)).alias("row")
    rows = pages.select(row, F.when(host(F.col(url_col)).isNotNull(), site).alias("site"), F.col(html_col).alias("html"))
    schema = f"row {rows.schema['row'].dataType.simpleString()}, site long, name long, blocks array<string>, hashes array<long>, firsts array<int>, ends array<int>"
    read = rows.mapInArrow(_blocks, schema).join(hits, ["site", "name"], "left")
    out = F.filter(F.arrays_zip("hashes", "firsts", "ends"), lambda s: F.array_contains("template", s["hashes"]))
    stays = lambda _, i: ~F.exists("out", lambda s: (s["firsts"] <= i) & (i < s["ends"]))
    cut = read.withColumn("out", F.when(F.col("template").isNotNull(), out))
    kept = F.when(F.col("template").isNull(), F.col("blocks")).otherwise(F.filter("blocks", stays))
    done = cut.select("row", F.array_join(kept, "\n").alias("text"), F.coalesce(F.size("template"), F.lit(0)).alias("n_template"))
    return done.select("row", "text", F.char_length("text").cast("long").alias("n_chars"), "n_template")
