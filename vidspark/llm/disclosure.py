r"""Personal data, and the terms that give it away, in DataFrame functions alone.

Protected entities are the valid e-mail addresses, IP addresses, card and phone numbers of the table. A term that keeps
standing near an entity can reveal it wherever it stands. How strongly is estimated from the corpus: with N documents, c(e)
of them with the entity, c(t) with the term and c(e, t) with the term near the entity, the entity carries
IC = log2(N / c(e)) bits, and the term tells PMI = log2(N c(e, t) / (c(e) c(t))) of them. A term discloses the entity if
PMI >= ALPHA IC and IC - PMI = log2(c(t) / c(e, t)) is at most HIDDEN_BITS, on the evidence of two different texts at
least. Disclosing terms are generalised; those with more than REMOVE_SHARE of their documents near the entity are removed.
Near means in the REACH characters before or after an entity, up to the next match of its kind.

Places come from two passes of a pattern, the matches and what lies between them, whose lengths are added up. The patterns
are the stated ones, written so that they never go back over a long run: a run that has failed once is not tried again from
its middle, and no group repeats by recursion.

Terms are counted in tables of one row a term; these are sent to all tasks only while they have at most SENT_TERMS rows,
else they are joined by key, with the same result. A text's own terms are gathered by the text's hash, so copies share them.

Defined results: a null text is an empty one and has no spans; repeated rows are scanned alike and count as documents of
their own, but as one text; null ids stay; columns other than id and text are left out; an empty table gives no row. Whole
texts are scanned however long they are. A term within a base span is not reported again. Spans that overlap are all
reported; in the sanitised text the first of them stands for all.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vidspark.llm.common import documents, lower_ascii, materialize

KINDS = ["email", "ip", "card", "phone"]
TERM_KIND = "term"
#: The patterns as stated.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: The same matches without going back.
LINEAR = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": PATTERNS["phone"],
}
PART_255 = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])(?:\.|$)){4}"
#: A term: a run of letters after A-Z are lower-cased, other scripts included, of MIN_LETTERS at least.
TERM, MIN_LETTERS = r"[^\x00-\x60\x7B-\x7F]+", 3
REACH, ALPHA, HIDDEN_BITS, REMOVE_SHARE = 80, 0.5, 1.0, 0.9
#: A table of terms is sent to all tasks up to so many rows (some 20 MB).
SENT_TERMS = 200_000
SUM_BLOCK = 256

_SPANS = "array<struct<start:bigint,kind:int,end:bigint,value:string,i:int>>"


def running_sums(numbers: Column) -> Column:
    """Inclusive running sums of an array of longs; blocks keep long arrays from being copied once an element."""
    zero = F.struct(F.array().cast("array<bigint>").alias("sums"), F.lit(0).cast("bigint").alias("s"))

    def summed(a: Column) -> Column:
        return F.aggregate(a, zero, lambda acc, v: F.struct(
            F.concat(acc["sums"], F.array(acc["s"] + v)).alias("sums"), (acc["s"] + v).alias("s")), lambda acc: acc["sums"])

    starts = F.sequence(F.lit(0), F.floor((F.size(numbers) - 1) / F.lit(SUM_BLOCK)).cast("int"))
    cut = F.transform(starts, lambda b: summed(F.slice(numbers, b * SUM_BLOCK + 1, F.lit(SUM_BLOCK))))
    ends = lambda c: summed(F.transform(c, lambda x: F.element_at(x, -1)))
    glued = F.aggregate(F.array(cut), F.array().cast("array<bigint>"), lambda _, c: F.flatten(F.zip_with(
        c, ends(c), lambda x, end: F.transform(x, lambda v: v + end - F.element_at(x, -1)))))
    return F.when(F.size(numbers) > 0, glued).otherwise(F.array().cast("array<bigint>"))


def _luhn(digits: Column) -> Column:
    def value(i: Column) -> Column:
        doubled = F.substr(digits, -i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return F.when(doubled > 9, doubled - 9).otherwise(doubled)
    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda s, i: s + value(i)) % 10 == 0


def _value(kind: str, match: Column) -> Column:
    """The entity a match stands for, null for one that fails."""
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "email":
        return lower_ascii(match)
    if kind == "ip":
        return F.when(match.rlike(PART_255), match)
    if kind == "card":  # 19 digits have 18 separators at most
        return F.when(F.length(match).between(12, 37), F.when(
            F.length(digits).between(12, 19), F.when(_luhn(digits), digits)))
    return F.when(F.length(digits).between(9, 15), F.concat(F.lit("+"), digits))


def _terms(text: Column) -> Column:
    """Distinct terms of a lower-cased text."""
    return F.array_distinct(F.filter(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)),
                                     lambda t: F.length(t) >= MIN_LETTERS))


def _beside(before: Column, after: Column) -> Column:
    """The lower-cased text near an entity, without terms that the limit may have cut."""
    left = F.when(F.length(before) > REACH, F.regexp_replace(lower_ascii(F.right(before, F.lit(REACH))), "^" + TERM, "")) \
        .otherwise(lower_ascii(before))
    right = F.when(F.length(after) > REACH, F.regexp_replace(lower_ascii(F.left(after, F.lit(REACH))), TERM + "$", "")) \
        .otherwise(lower_ascii(after))
    return F.concat(left, F.lit(" "), right)


def _ends(matches: str, between: str) -> Column:
    """Where each match ends, from the matches and the texts around them."""
    return running_sums(F.transform(matches, lambda m, i: (F.length(F.get(between, i)) + F.length(m)).cast("bigint")))


def _valid(k: int, kind: str) -> Column:
    """The matches of a kind that stand for an entity, with their number among all matches."""
    spans = F.transform(f"m{k}", lambda m, i: F.struct(
        (F.get(f"e{k}", i) - F.length(m)).alias("start"), F.lit(k).alias("kind"), F.get(f"e{k}", i).alias("end"),
        _value(kind, m).alias("value"), i.alias("i")))
    return F.filter(spans, lambda s: s["value"].isNotNull()).cast(_SPANS)


def _near(k: int, kind: str) -> Column:
    """'entity newline term' for the terms beside each entity of a kind."""
    def terms(s: Column) -> Column:
        beside = _terms(_beside(F.get(f"p{k}", s["i"]), F.get(f"p{k}", s["i"] + 1)))
        return F.transform(beside, lambda t: F.concat(F.lit(f"{kind}:"), s["value"], F.lit("\n"), t))
    return F.flatten(F.transform(f"v{k}", terms))


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    whole = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(doc_id).alias("doc_id"), whole.alias("text"), F.unhex(F.md5(whole.cast("binary"))).alias("key"))


def entities(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, key, base: start, kind, end and value of each entity, near: distinct 'entity newline term' of a text)."""
    rows = _keyed(docs, doc_id, text)
    t, none = F.col("text"), F.array().cast("array<string>")
    worth = {"email": F.contains(t, F.lit("@")), "phone": F.contains(t, F.lit("+"))}
    rows = rows.withColumns({f"m{k}": F.when(worth.get(kind, F.lit(True)), F.regexp_extract_all(
        t, F.lit(LINEAR[kind]), F.lit(0))).otherwise(none) for k, kind in enumerate(KINDS)})
    rows = rows.withColumns({f"p{k}": F.when(F.size(f"m{k}") > 0, F.split(t, LINEAR[kind], -1)).otherwise(none)
                             for k, kind in enumerate(KINDS)})
    rows = rows.withColumns({f"e{k}": _ends(f"m{k}", f"p{k}") for k in range(len(KINDS))})
    rows = rows.withColumns({f"v{k}": _valid(k, kind) for k, kind in enumerate(KINDS)})
    plain = lambda s: F.struct(*[s[c].alias(c) for c in ("start", "kind", "end", "value")])
    return rows.select("doc_id", "key",
                       F.array_sort(F.concat(*[F.transform(f"v{k}", plain) for k in range(len(KINDS))])).alias("base"),
                       F.array_distinct(F.concat(*[_near(k, kind) for k, kind in enumerate(KINDS)])).alias("near"))


def _joined(many: DataFrame, terms: DataFrame, rows: int) -> DataFrame:
    return many.join(F.broadcast(terms) if rows <= SENT_TERMS else terms, "term")


def disclosing_terms(docs: DataFrame, found: DataFrame, text: str = "text") -> DataFrame:
    """(term, share): the largest share of a term's documents that have it near one and the same entity it discloses."""
    spark = docs.sparkSession
    total = found.count()
    pairs = found.select(F.xxhash64("key").alias("of"), F.explode("near").alias("pair")).groupBy("pair").agg(
        F.count("*").alias("both"), F.min("of").alias("a"), F.max("of").alias("b")).where("a <> b")
    pairs = pairs.select(F.substring_index("pair", "\n", 1).alias("entity"), F.substring_index("pair", "\n", -1).alias("term"),
                         "both")
    kinds = F.array(*[F.lit(k) for k in KINDS])
    named = F.array_distinct(F.transform("base", lambda s: F.concat(F.get(kinds, s["kind"]), F.lit(":"), s["value"])))
    seen = found.select(F.explode(named).alias("entity")).groupBy("entity").agg(F.count("*").alias("c")).where("c > 1")
    pairs = materialize(pairs.join(seen, "entity"), "pairs")
    terms = materialize(pairs.select("term").distinct(), "terms")
    rows = terms.count()
    if not rows:
        return spark.createDataFrame([], "term string, share double")
    each = docs.select(F.explode(_terms(lower_ascii(F.coalesce(F.col(text), F.lit(""))))).alias("term"))
    if rows <= SENT_TERMS:
        counts = _joined(each, terms, rows).groupBy("term").agg(F.count("*").alias("t"))
    else:
        counts = each.groupBy("term").agg(F.count("*").alias("t")).join(terms, "term")
    share = F.col("both") / F.col("t")
    carried = F.lit(float(total)) / F.col("c")
    told = share * carried  # 2 to the power of PMI
    return pairs.join(counts, "term").where((carried > 1) & (told >= F.pow(carried, F.lit(ALPHA)))
                                            & (share >= 2.0 ** -HIDDEN_BITS)).groupBy("term").agg(F.max(share).alias("share"))


def _placed(docs: DataFrame, flagged: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(key, terms: start, end and share of the disclosing terms), a row for each different text that has one."""
    rows = flagged.count()
    keyed = _keyed(docs, doc_id, text).select("key", lower_ascii(F.col("text")).alias("text"))
    hits = _joined(keyed.select("key", F.explode(_terms(F.col("text"))).alias("term")), flagged, rows).groupBy("key").agg(
        F.map_from_entries(F.collect_set(F.struct("term", "share"))).alias("shares"))
    hits = materialize(hits, "hits")
    whole = keyed.join(hits, "key")
    whole = whole.withColumns({"m": F.regexp_extract_all("text", F.lit(TERM), F.lit(0)), "p": F.split("text", TERM, -1)})
    whole = whole.withColumn("e", _ends("m", "p"))
    spans = F.filter(F.transform("m", lambda m, i: F.struct(
        (F.get("e", i) - F.length(m)).alias("start"), F.get("e", i).alias("end"),
        F.try_element_at("shares", m).alias("share"))), lambda s: s["share"].isNotNull())
    return whole.select("key", spans.alias("terms")).dropDuplicates(["key"])


def scanned(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, key, base: start, kind, end, value; terms: start, end, share), a row for each row."""
    found = materialize(entities(docs, doc_id, text), "entities")
    flagged = materialize(disclosing_terms(docs, found, text), "disclosing")
    placed = _placed(docs, flagged, doc_id, text)
    apart = F.filter("terms", lambda t: ~F.exists("base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
    none = F.array().cast("array<struct<start:bigint,end:bigint,share:double>>")
    return found.join(placed, "key", "left").select("doc_id", "key", "base", F.coalesce(apart, none).alias("terms"))


def _all_spans(place: Callable[[Column, Column | int], Column]) -> Column:
    base = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"),
                                                  place(s, 0).alias("as")))
    terms = F.transform("terms", lambda s: F.struct(s["start"].alias("start"), F.lit(len(KINDS)).alias("kind"),
                                                    s["end"].alias("end"), place(s, 1).alias("as")))
    return F.array_sort(F.concat(base, terms))


def sanitised(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text): entities become their kind in brackets; disclosing terms become [term], or nothing beyond
    REMOVE_SHARE."""
    kinds = F.array(*[F.lit(f"[{k}]") for k in KINDS])

    def place(s: Column, term: int) -> Column:
        if term:
            return F.when(s["share"] > REMOVE_SHARE, F.lit("")).otherwise(F.lit(f"[{TERM_KIND}]"))
        return F.get(kinds, s["kind"])

    marked = scanned(docs, doc_id, text).select("key", _all_spans(place).alias("spans")).dropDuplicates(["key"])
    zero = F.struct(F.array().cast("array<struct<start:bigint,kind:int,end:bigint,as:string>>").alias("kept"),
                    F.lit(0).cast("bigint").alias("to"))
    kept = F.aggregate("spans", zero, lambda acc, s: F.when(s["start"] >= acc["to"], F.struct(
        F.concat(acc["kept"], F.array(s)).alias("kept"), s["end"].alias("to"))).otherwise(acc), lambda acc: acc["kept"])
    rows = _keyed(docs, doc_id, text).join(marked, "key").withColumn("kept", kept)
    before = lambda i: F.when(i > 0, F.get("kept", i - 1)["end"]).otherwise(F.lit(0))
    pieces = F.transform("kept", lambda s, i: F.concat(
        F.substr(F.col("text"), (before(i) + 1).cast("int"), (s["start"] - before(i)).cast("int")), s["as"]))
    rest = F.substr(F.col("text"), (F.coalesce(F.element_at("kept", -1)["end"], F.lit(0)) + 1).cast("int"))
    return rows.select("doc_id", F.when(F.size("kept") > 0, F.concat(F.array_join(pieces, ""), rest))
                       .otherwise(F.col("text")).alias("text"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*[F.lit(k) for k in [*KINDS, TERM_KIND]])
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(k: int, kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{kind}")
    return scanned(documents(spark, sf_dir)).select(
        "doc_id", *[count(k, kind) for k, kind in enumerate(KINDS)], F.sha2(joined("base").cast("binary"), 256).alias("base_sha256"),
        joined(_all_spans(lambda s, _: F.lit(""))).alias("spans"))


def _sql() -> str:
    quoted = {k: p.replace("'", "''") for k, p in PATTERNS.items()}
    raw = " UNION ALL ".join(f"""SELECT r, {k} AS k, '{kind}' AS kind, regexp_extract_all(t, '{quoted[kind]}') AS m,
      string_split_regex(t, '{quoted[kind]}') AS p FROM docs""" for k, kind in enumerate(KINDS))
    return rf"""
WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
raw AS ({raw}),
match AS (SELECT r, k, kind, unnest(m) AS m, unnest(p[1:len(m)]) AS l, unnest(p[2:len(m) + 1]) AS n,
  unnest(range(len(m))) AS i FROM raw WHERE len(m) > 0),
placed AS (SELECT *, regexp_replace(m, '[^0-9]', '', 'g') AS d,
  (sum(length(l) + length(m)) OVER (PARTITION BY r, k ORDER BY i))::BIGINT AS e FROM match),
base AS MATERIALIZED (SELECT r, k, kind, e - length(m) AS s, e, l, n,
    kind || ':' || CASE kind WHEN 'email' THEN translate(m, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
      WHEN 'ip' THEN m WHEN 'card' THEN d ELSE '+' || d END AS entity FROM placed
  WHERE CASE kind WHEN 'email' THEN true
    WHEN 'ip' THEN len(list_filter(string_split(m, '.'), lambda x: coalesce(try_cast(x AS HUGEINT), 256) > 255)) = 0
    WHEN 'card' THEN length(d) BETWEEN 12 AND 19 AND list_sum(list_transform(range(1, length(d) + 1), lambda i:
      substring(d, length(d) - i + 1, 1)::INTEGER * (2 - i % 2) - CASE WHEN i % 2 = 0 AND substring(d, length(d) - i + 1, 1)
      >= '5' THEN 9 ELSE 0 END)) % 10 = 0
    ELSE length(d) BETWEEN 9 AND 15 END),
beside AS (SELECT r, entity,
  CASE WHEN length(l) > {REACH} THEN regexp_replace(translate(right(l, {REACH}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '^{TERM}', '') ELSE translate(l, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz') END || ' ' ||
  CASE WHEN length(n) > {REACH} THEN regexp_replace(translate(left(n, {REACH}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '{TERM}$', '') ELSE translate(n, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz') END AS x FROM base),
near AS (SELECT DISTINCT r, entity, term FROM (SELECT r, entity, unnest(regexp_extract_all(x, '{TERM}')) AS term FROM beside)
  WHERE length(term) >= {MIN_LETTERS}),
pair AS (SELECT entity, term, count(*) AS both_ FROM near JOIN docs USING (r)
  GROUP BY entity, term HAVING count(DISTINCT t) > 1),
seen AS (SELECT entity, count(DISTINCT r) AS c FROM base GROUP BY entity),
lowered AS (SELECT r, translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM docs),
wordlist AS (SELECT r, regexp_extract_all(t, '{TERM}') AS m, string_split_regex(t, '{TERM}') AS p FROM lowered),
word AS MATERIALIZED (SELECT r, term, (sum(gap + length(term)) OVER (PARTITION BY r ORDER BY i))::BIGINT AS e FROM (
  SELECT r, unnest(m) AS term, unnest([length(g) for g in p[1:len(m)]]) AS gap, unnest(range(len(m))) AS i FROM wordlist)),
counted AS (SELECT term, count(DISTINCT r) AS t FROM word WHERE term IN (SELECT term FROM pair) GROUP BY term),
total AS (SELECT count(*)::DOUBLE AS n FROM docs),
disclosing AS (SELECT DISTINCT term FROM pair JOIN seen USING (entity) JOIN counted USING (term), total
  WHERE n / c > 1 AND both_ / t * (n / c) >= pow(n / c, {ALPHA}) AND both_ / t >= {2.0 ** -HIDDEN_BITS}),
flagged AS (SELECT r, e - length(term) AS s, e FROM word JOIN disclosing USING (term)),
span AS (SELECT r, s, k, e, kind || ':' || s || ':' || e AS x FROM base UNION ALL
  SELECT r, s, {len(KINDS)}, e, '{TERM_KIND}:' || s || ':' || e FROM flagged f
  WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.r = f.r AND b.s < f.e AND f.s < b.e))
SELECT any_value(doc_id) AS doc_id, {", ".join(f"count(*) FILTER (k = {k}) AS n_{kind}" for k, kind in enumerate(KINDS))},
  sha256(coalesce(string_agg(x, ',' ORDER BY s, k, e) FILTER (k < {len(KINDS)}), '')) AS base_sha256,
  coalesce(string_agg(x, ',' ORDER BY s, k, e), '') AS spans
FROM docs LEFT JOIN span USING (r) GROUP BY docs.r
"""


SQL = _sql()
