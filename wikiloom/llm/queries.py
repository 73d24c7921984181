"""Queries of the text problems: p2 (pieces), p4 (mark-up), p7 (containers), p8 (leaks), p9 (look-alikes)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from wikiloom.functions.text import to_id
from wikiloom.llm import canonical, chunking, leakage, markup, packing
from wikiloom.session import materialize
from wikiloom.sources.tables import last_value, read_table


def last_rows(spark: SparkSession, folder: str) -> DataFrame:
    """(page_id, host, crawled_at, text) of every row of the last snapshot, outdated and repeated ones too."""
    records = read_table(spark, folder, "page_records")
    host = F.concat_ws("/", F.regexp_extract("source_url", "^[a-z]+://([^/?#]+)", 1), "space_key")
    rows = records.where(F.col("run_id") == last_value(records, "run_id"))
    return rows.select(to_id("id").alias("page_id"), host.alias("host"), "crawled_at", F.col("storage_format_sample").alias("text")).where("page_id IS NOT NULL")


def current(rows: DataFrame, found: DataFrame) -> DataFrame:
    """What was found in the latest row of each page; ``found`` has page_id and crawled_at of its row. Texts take no part."""
    last = rows.groupBy("page_id").agg(F.max("crawled_at").alias("last"))
    return found.join(last, (found["page_id"] == last["page_id"]) & found["crawled_at"].eqNullSafe(last["last"]), "left_semi").drop("crawled_at")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    rows = last_rows(spark, folder)
    long = rows.where(F.length("text") > chunking.LIMIT).select(F.struct("page_id", "crawled_at").alias("at"), "text")
    cut = chunking.pieces(long, "at", "text", texts=False).select("at.*", "forced")
    kinds = current(rows, cut).groupBy("page_id").agg(F.bool_or("forced").alias("forced"))
    return kinds.select("page_id", F.when(F.col("forced"), "forced").otherwise("natural").alias("cut_type"))


def p2_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """The pieces themselves, of all texts of the last snapshot."""
    rows = last_rows(spark, folder)
    cut = chunking.pieces(rows.select(F.struct("page_id", "crawled_at").alias("at"), "text"), "at", "text")
    return current(rows, cut.select("at.*", "piece", "start", "overlap", "forced", "text")).distinct()


def p2_joined(spark: SparkSession, folder: str) -> DataFrame:
    """Round trip of the pieces: their own parts put together, how many are over the limit, and how many do not begin with
    the end of the piece before."""
    cut = p2_pieces(spark, folder)
    own = F.struct("piece", F.expr("substring(text, overlap + 1)").alias("own"), F.expr("substring(text, 1, overlap)").alias("again"), "text")
    each = cut.groupBy("page_id").agg(F.array_sort(F.collect_list(own)).alias("p"))
    broken = F.size(F.filter("p", lambda x: (x["piece"] > 0) & ~F.endswith(F.try_element_at("p", x["piece"])["text"], x["again"])))
    return each.select(
        "page_id", F.array_join(F.transform("p", lambda x: x["own"]), "").alias("text"), F.size(F.filter("p", lambda x: F.length(x["text"]) > chunking.LIMIT)).alias("over"), broken.alias("broken")
    )


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return markup.structures(last_rows(spark, folder), "page_id", "host", "text", "crawled_at")


def _sizes(spark: SparkSession, folder: str) -> DataFrame:
    return packing.token_counts(read_table(spark, folder, "documents"), "doc_id", "text")


def p7_containers(spark: SparkSession, folder: str) -> DataFrame:
    """Which container each text (or piece of an oversized one) goes to: as few containers of 2,048 tokens as possible,
    each shrunk to the least permitted length that holds its contents."""
    return packing.pack(_sizes(spark, folder), "doc_id")


def p7_lengths(spark: SparkSession, folder: str) -> DataFrame:
    """The same texts in sequences of several lengths that cost the least training work together, by length."""
    return packing.lengths_used(packing.pack(_sizes(spark, folder), "doc_id", cost=packing.attention))


def p7_whole(spark: SparkSession, folder: str) -> DataFrame:
    """What every packing keeps to: all texts are there with all their tokens, no container holds more than its length, and
    only a text over the capacity is split."""
    sizes = materialize(_sizes(spark, folder))
    packed = materialize(packing.pack(sizes, "doc_id"))
    again = packed.groupBy("doc_id").agg(F.sum("tokens").alias("placed"), F.count("*").alias("parts"))
    both = sizes.join(again, "doc_id", "left")
    over = packed.where("container IS NOT NULL").groupBy("container").agg(F.sum("tokens").alias("held"), F.max("container_capacity").alias("cap")).where("held > cap")
    wrong = both.agg(
        F.count("*").alias("texts"), F.count_if(~F.col("tokens").eqNullSafe(F.col("placed"))).alias("lost"), F.count_if((F.col("parts") > 1) & (F.col("tokens") <= packing.CAPACITY)).alias("split")
    )
    rows = wrong.unionByName(over.agg(F.count("*").alias("overfull")), allowMissingColumns=True)
    return rows.agg(*[F.max(c).alias(c) for c in rows.columns])


def _leaks(spark: SparkSession, folder: str, least: float) -> DataFrame:
    return leakage.leaks(read_table(spark, folder, "documents"), read_table(spark, folder, "eval_items"), least=least)


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return _leaks(spark, folder, 2.0).where("exact").select("doc_id", "item_id").distinct()


def p8_coverage(spark: SparkSession, folder: str, least: float = 0.3) -> DataFrame:
    """Documents that hold much of a test item in whatever order: how much of it lies under tiles, and the longest tile."""
    found = _leaks(spark, folder, least).where(F.col("coverage") >= least)
    return found.select("doc_id", "item_id", "tiles", "longest", F.round("coverage", 6).alias("coverage")).distinct()


def p8_items(spark: SparkSession, folder: str, least: float = 0.5) -> DataFrame:
    """Test items that leaked: documents with a verbatim passage, and documents that cover at least half of the item."""
    found = _leaks(spark, folder, least)
    counts = found.groupBy("item_id").agg(F.count_if("exact").alias("verbatim"), F.count_if(F.col("coverage") >= least).alias("covered"))
    return counts.where("verbatim > 0 OR covered > 0")


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return canonical.look_alike_pairs(read_table(spark, folder, "documents"))


def p9_classes(spark: SparkSession, folder: str) -> DataFrame:
    """The same as classes of documents that read the same and spellings within them."""
    return canonical.look_alike_classes(read_table(spark, folder, "documents"))


QUERIES = {f.__name__: f for f in (p2_found, p2_pieces, p2_joined, p4_found, p7_containers, p7_lengths, p7_whole, p8_found, p8_coverage, p8_items, p9_found, p9_classes)}

_LAST = """SELECT TRY_CAST(trim(id) AS BIGINT) AS page_id, storage_format_sample AS t FROM page_records
  WHERE run_id = (SELECT max(run_id) FROM page_records)
  QUALIFY row_number() OVER (PARTITION BY TRY_CAST(trim(id) AS BIGINT) ORDER BY crawled_at DESC NULLS LAST) = 1"""

#: Fixed values of the SQL twins, which take nothing from the operators: look-alike letters, and what they look like.
_CYRILLIC = "асԁеһіјӏорԛѕԝхуАВСЕԌНІЈКМОРԚЅТԜХҮ", "acdehijlopqswxyABCEGHIJKMOPQSTWXY"
_GREEK = "αιϳορυνγΑΒΕΗΙΚΜΝΟΡΤΧΥΖ", "aijopuvyABEHIKMNOPTXYZ"
_ARMENIAN = "հոօսՕՏ", "hnouOS"


def _twins_to_latin() -> tuple[str, str]:
    """Every letter with a Latin twin (accented ones too), width form and kind of space, and what it reads like."""
    import unicodedata

    pairs = {a: b for old, new in (_CYRILLIC, _GREEK, _ARMENIAN) for a, b in zip(old, new, strict=True)}
    pairs |= {chr(cp): chr(cp - 0xFEE0) for cp in range(0xFF01, 0xFF5F)}
    pairs |= {c: " " for c in "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"} | {"\u2010": "-", "\u2011": "-"}
    for cp in (*range(0x370, 0x530), *range(0x1F00, 0x2000)):
        base, *marks = unicodedata.normalize("NFD", chr(cp))
        whole = unicodedata.normalize("NFC", pairs.get(base, base) + "".join(marks))
        if marks and base in pairs and len(whole) == 1:
            pairs[chr(cp)] = whole
    pairs |= {chr(cp): unicodedata.normalize("NFKC", chr(cp)) for cp in range(0xFF61, 0xFF9E)} | {"\uff9e": "\u3099", "\uff9f": "\u309a"}
    return "".join(pairs), "".join(pairs.values())


def _skeleton() -> str:
    """SQL for a form in which everything that has a Latin twin is Latin. It names no script, so it is no form to store
    text in, but two texts have the same skeleton exactly if they read the same."""
    import unicodedata

    old, new = ("'" + x.replace("'", "''") + "'" for x in _twins_to_latin())
    text = f"translate(regexp_replace(text, '[\\x{{00ad}}\\x{{200b}}-\\x{{200f}}\\x{{2060}}-\\x{{2064}}\\x{{feff}}]', '', 'g'), {old}, {new})"
    for cp in range(0xFB00, 0xFB05):
        text = f"replace({text}, '{chr(cp)}', '{unicodedata.normalize('NFKC', chr(cp))}')"
    return f"nfc_normalize({text})"


def _p8_words() -> str:
    """d(doc_id, w) and e(item_id, w): the words of documents and items."""
    plain = r"regexp_replace(regexp_replace(text, '\[([^\[\]\n]*)\]\([^()\s]*\)', '\1', 'g'), '</?(b|i|u|em|strong|span|code|a|s)\b[^<>]*>', '', 'gi')"
    plain = rf"regexp_replace({plain}, '<[a-zA-Z/!][^<>]*>|&(amp|lt|gt|nbsp|quot|#39);', ' ', 'g')"
    word = f"regexp_extract_all(replace(lower({_skeleton().replace('(text,', f'({plain},')}), 'ß', 'ss'), '[\\pL\\pN\\pM]+')"
    return f"d AS (SELECT doc_id, {word} AS w FROM documents WHERE text IS NOT NULL), e AS (SELECT item_id, {word} AS w FROM eval_items WHERE text IS NOT NULL)"


#: Pairs that share thirteen words of which twelve agree, and therefore the first or the last six.
_P8_EXACT = """dw AS (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13), ew AS (SELECT item_id, w, unnest(range(1, len(w) - 11)) AS i FROM e WHERE len(w) >= 13),
dg AS (SELECT doc_id, w[i:i + 12] AS g FROM dw), eg AS (SELECT item_id, w[i:i + 12] AS g FROM ew),
pairs AS (SELECT doc_id, item_id, dg.g AS a, eg.g AS b FROM dg JOIN eg ON dg.g[1:6] = eg.g[1:6] UNION ALL SELECT doc_id, item_id, dg.g, eg.g FROM dg JOIN eg ON dg.g[8:13] = eg.g[8:13]),
exact AS (SELECT DISTINCT doc_id, item_id FROM pairs WHERE len(list_filter(range(1, 14), lambda k: a[k] = b[k])) >= 12)"""
#: Greedy tiling: maximal runs of shared words; each round takes the longest of a pair and cuts its words out of the others.
_P8_TILES = """ds AS (SELECT doc_id, i, w[i:i + 5] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 4)) AS i FROM d WHERE len(w) >= 6)),
es AS (SELECT item_id, j, w[j:j + 5] AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 4)) AS j FROM e WHERE len(w) >= 6)),
seeds AS (SELECT doc_id, item_id, i, j, i - row_number() OVER (PARTITION BY doc_id, item_id, i - j ORDER BY i) AS run FROM ds JOIN es USING (g)),
runs AS (SELECT doc_id, item_id, min(i) AS i, min(j) AS j, count(*) + 5 AS n FROM seeds GROUP BY doc_id, item_id, i - j, run),
rounds(doc_id, item_id, i, j, n, tile) AS (
  SELECT *, FALSE FROM runs
  UNION ALL
  SELECT doc_id, item_id, i + x.a, j + x.a, x.b - x.a, x.t FROM (
    SELECT r.*, unnest(CASE WHEN r.i = b.i AND r.j = b.j THEN [{'a': 0, 'b': r.n, 't': TRUE}]
      ELSE [{'a': 0, 'b': least(r.n, b.i - r.i, b.j - r.j), 't': FALSE},
            {'a': greatest(0, least(b.i - r.i, b.j - r.j) + b.n), 'b': least(r.n, greatest(b.i - r.i, b.j - r.j)), 't': FALSE},
            {'a': greatest(0, greatest(b.i - r.i, b.j - r.j) + b.n), 'b': r.n, 't': FALSE}] END) AS x
    FROM rounds r JOIN (SELECT * FROM rounds WHERE NOT tile QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY n DESC, i, j) = 1) b
      ON b.doc_id = r.doc_id AND b.item_id = r.item_id WHERE NOT r.tile) WHERE x.b - x.a >= 6),
covered AS (SELECT doc_id, item_id, count(*) AS tiles, max(n) AS longest, sum(n) / any_value(len(e.w)) AS coverage FROM rounds JOIN e USING (item_id) WHERE tile GROUP BY doc_id, item_id)"""


def _p9_sql() -> str:
    return f"""WITH d AS (SELECT doc_id, text, {_skeleton()} AS form FROM documents WHERE text IS NOT NULL)
SELECT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM d a JOIN d b ON a.form = b.form AND a.doc_id < b.doc_id AND a.text <> b.text"""


SQL = {
    "p2_joined": f"SELECT page_id, t AS text, 0 AS over, 0 AS broken FROM ({_LAST}) WHERE t IS NOT NULL",
    "p7_whole": "SELECT count(*) AS texts, 0 AS lost, 0 AS split, 0 AS overfull FROM documents",
    "p8_found": f"WITH {_p8_words()}, {_P8_EXACT} SELECT doc_id, item_id FROM exact",
    "p8_coverage": f"WITH RECURSIVE {_p8_words()}, {_P8_TILES} SELECT doc_id, item_id, tiles, longest, round(coverage, 6) AS coverage FROM covered WHERE coverage >= 0.3",
    "p8_items": f"""WITH RECURSIVE {_p8_words()}, {_P8_EXACT}, {_P8_TILES},
both_ AS (SELECT item_id, x.doc_id IS NOT NULL AS verbatim, coalesce(c.coverage, 0) >= 0.5 AS much FROM exact x FULL JOIN covered c USING (doc_id, item_id))
SELECT item_id, count(*) FILTER (verbatim) AS verbatim, count(*) FILTER (much) AS covered FROM both_ WHERE verbatim OR much GROUP BY 1""",
    "p9_found": _p9_sql(),
    "p9_classes": f"""WITH d AS (SELECT doc_id, text, {_skeleton()} AS form FROM documents WHERE text IS NOT NULL)
SELECT doc_id, min(doc_id) OVER (PARTITION BY form) AS class_id, min(doc_id) OVER (PARTITION BY form, text) AS spelling_id FROM d QUALIFY min(text) OVER (PARTITION BY form) <> max(text) OVER (PARTITION BY form)""",
    "p2_found": f"""
SELECT page_id, CASE WHEN list_max(list_transform(regexp_split_to_array(t, '\\s+'), lambda x: length(x))) > 3000 THEN 'forced' ELSE 'natural' END AS cut_type
FROM ({_LAST}) WHERE length(t) > 3000""",
}
