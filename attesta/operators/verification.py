"""Claims against texts: containment joins, pattern counts, mentions, blocklists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions import text, urls

# First labels of domains that are no shops.
MARKETPLACES = (
    "amazon", "ebay", "ebay-kleinanzeigen", "kleinanzeigen", "otto", "kaufland", "hood", "etsy", "temu", "shein", "aliexpress", "wish", "zalando", "aboutyou", "avocadostore", "manomano", "realde", "real",
    "galaxus", "digitec", "conrad", "mediamarkt", "saturn", "idealo", "geizhals", "billiger", "guenstiger", "preisvergleich", "check24", "verivox", "testberichte", "trustedshops", "trustpilot", "google",
    "facebook", "instagram", "pinterest", "youtube", "tiktok", "wikipedia", "shopify", "shopware", "woocommerce", "etracker", "gelbeseiten", "wlw", "europages",
)
#: Words of the block that a passage and a document must share before they are compared, and characters of shorter ones.
BLOCK_WORDS, BLOCK_CHARS = 4, 8


def contained(documents: DataFrame, passages: DataFrame) -> DataFrame:
    """(doc_id, item_id) of every passage that stands in a document, both normalised.

    Blocked, so that documents meet passages by equi-joins only, and the comparison runs on those pairs
    alone. A passage of ``BLOCK_WORDS`` inner words or more can only stand where the hash of its first inner
    words does (its first and last words may be parts of longer words in a text). A shorter one can only
    stand where its first characters do, ``BLOCK_CHARS`` of them or all.
    """
    p = passages.select("item_id", text.normalised(F.col("text")).alias("p")).where("p <> ''").withColumn("words", F.split("p", " "))
    n = BLOCK_WORDS
    long = p.where(F.size("words") >= n + 2).select("item_id", "p", F.xxhash64(*[F.get("words", F.lit(i + 1)) for i in range(n)]).alias("key"))
    short = p.where(F.size("words") < n + 2).select("item_id", "p", F.least(F.length("p"), F.lit(BLOCK_CHARS)).alias("size"))
    sizes = [r["size"] for r in short.select("size").distinct().collect()]  # BLOCK_CHARS of them at most

    def met(keys, wanted: DataFrame) -> DataFrame:
        found = documents.select("doc_id", text.normalised(F.col("text")).alias("d")).select("doc_id", F.explode(F.array_distinct(keys)).alias("key"))
        return found.join(wanted, "key").select("doc_id", "item_id", "p")

    words = F.split("d", " ")
    grams = text.let(words, lambda w: F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - n, F.lit(0))), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(n)])))
    hits = met(grams, long)

    def pieces(size: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.length("d") - size + 1, F.lit(1))), lambda i: F.substring("d", i, F.lit(size)))

    if sizes:
        starts = F.concat(*[pieces(size) for size in sizes])
        hits = hits.unionByName(met(starts, short.withColumn("key", F.expr("substring(p, 1, size)"))))
    pairs = hits.distinct()
    # Only documents that met a passage are normalised again.
    return documents.select("doc_id", "text").join(pairs, "doc_id").where(F.contains(text.normalised(F.col("text")), F.col("p"))).select("doc_id", "item_id").distinct()


def presence(rows: DataFrame, whole: Column, block: Column, patterns: dict[str, str]) -> DataFrame:
    """(pattern, whole, block): in how many rows each pattern stands in the page and in its block, in one pass."""
    sums = [F.count_if(F.regexp_like(where, F.lit(p))).alias(f"{n}_{kind}") for n, p in patterns.items() for kind, where in (("w", whole), ("b", block))]
    wide = rows.agg(*sums)
    pairs = F.array(*[F.struct(F.lit(n).alias("pattern"), F.col(f"{n}_w").alias("whole"), F.col(f"{n}_b").alias("block")) for n in patterns])
    return wide.select(F.explode(pairs).alias("p")).select("p.*")


def spans(block: Column) -> Column:
    """Distinct postal codes with a place, in order. Personal data: for counting, never to be stored."""
    return F.array_distinct(F.regexp_extract_all(block, F.lit(r"((?:[A-Z]{1,2}-)?[0-9]{4,5}\s+[A-ZÄÖÜ][\p{L}.-]+)"), F.lit(1)))


def mentions(answers: DataFrame, group: str, answer: Column, terms: tuple[str, ...]) -> DataFrame:
    """(term, conversations, answers): distinct groups with a term in an answer, and all answers."""
    hit = F.array(*[F.struct(F.lit(t).alias("term"), text.mentioned(F.col("__a"), F.array(F.lit(t))).alias("hit")) for t in terms])
    rows = answers.select(F.col(group), answer.alias("__a")).select(group, F.explode(hit).alias("h")).select(group, "h.*")
    return rows.groupBy("term").agg(F.count_distinct(F.when(F.col("hit"), F.col(group))).alias("conversations"), F.count("*").alias("answers"))


def competitors(answers: DataFrame) -> DataFrame:
    """(company_id, query_no, position, brand) -> brands over all of a company's queries, the first spelling of each, in order."""
    first = answers.groupBy("company_id", F.lower("brand").alias("key")).agg(F.min(F.struct("query_no", "position", "brand")).alias("f"))
    return first.groupBy("company_id").agg(F.transform(F.array_sort(F.collect_list("f")), lambda f: f["brand"]).alias("brands"))


def marketplace(domain: Column) -> Column:
    return F.coalesce(F.element_at(F.split(F.regexp_replace(F.lower(domain), r"^www\.", ""), r"\."), 1).isin(*MARKETPLACES), F.lit(False))


def address_parts(address: Column) -> Column:
    """struct<postal_code, city, country> of a formatted address: the first part with a code and a place, the country from the last part."""
    parts = F.transform(F.split(address, ","), lambda p: F.trim(p))
    coded = F.get(F.filter(parts, lambda p: p.rlike(r"^[0-9]{4,5}\s+\S")), 0)
    last = F.lower(F.element_at(parts, -1))
    country = F.when(last.isin("deutschland", "germany"), "DE").when(last.isin("österreich", "austria"), "AT").when(last.isin("schweiz", "switzerland"), "CH")
    return F.struct(F.nullif(F.regexp_extract(coded, r"^([0-9]{4,5})", 1), F.lit("")).alias("postal_code"), F.nullif(F.regexp_extract(coded, r"^[0-9]{4,5}\s+(.+)$", 1), F.lit("")).alias("city"), country.alias("country"))


def shops(answer: Column) -> Column:
    """Domains out of an answer ``{"shops": [...]}`` of strings or objects; null if it cannot be parsed, empty if it names none."""
    found = F.try_parse_json(answer)
    as_objects = F.from_json(F.try_variant_get(found, "$.shops", "string"), "array<struct<domain:string,url:string>>")
    as_texts = F.from_json(F.try_variant_get(found, "$.shops", "string"), "array<string>")
    named = F.transform(as_objects, lambda o: F.coalesce(o["domain"], o["url"]))
    return F.when(found.isNull(), None).when(F.size(F.array_compact(named)) > 0, F.array_compact(named)).otherwise(F.coalesce(F.filter(as_texts, lambda t: ~t.startswith("{")), F.array().cast("array<string>")))


def discovered(answers: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new companies, report of (measure, n)) out of (call, answer) rows, a call being one paid answer.

    A company: domain, legal_name, country, the first spelling by call and place. Marketplaces and unusable
    domains are counted, not kept, as are answers that cannot be read; ``known``: domain of companies that exist.
    """
    kind = "array<struct<domain:string,name:string>>"
    parsed = F.try_parse_json(text.json_object(F.col("answer")))
    listed = F.from_json(F.try_variant_get(parsed, "$.shops", "string"), "array<string>")
    as_objects = F.transform(listed, lambda x: F.when(x.startswith("{"), F.from_json(x, "domain string, name string")).otherwise(F.struct(x.alias("domain"), F.lit("").alias("name"))))
    rows = answers.select("call", as_objects.cast(kind).alias("shops"))
    shops = rows.select("call", F.posexplode("shops").alias("place", "s")).select("call", "place", F.trim("s.domain").alias("raw"), F.nullif(F.trim("s.name"), F.lit("")).alias("name")).where("coalesce(raw, '') <> ''")
    shops = shops.withColumn("domain", urls.normalised_domain(F.col("raw")))
    usable = shops.where(F.col("domain").isNotNull() & ~marketplace(F.col("domain")))
    first = usable.groupBy("domain").agg(F.min(F.struct("call", "place", "name")).alias("f"))
    fresh = first.join(known.select("domain"), "domain", "left_anti").select("domain", F.col("f.name").alias("legal_name"), urls.country(F.col("domain"), F.lit(None).cast("string")).alias("country"))

    def report(of: DataFrame, **counts: Column) -> DataFrame:
        sums = of.agg(*[c.alias(n) for n, c in counts.items()])
        return sums.select(F.explode(F.array(*[F.struct(F.lit(n).alias("measure"), F.col(n).alias("n")) for n in counts])).alias("r")).select("r.*")

    calls = report(rows, calls=F.count("*"), unparsed=F.count_if(F.col("shops").isNull()))
    return fresh, calls.unionByName(report(shops, unusable=F.count_if(F.col("domain").isNull()), marketplaces=F.count_if(marketplace(F.col("domain")))))
