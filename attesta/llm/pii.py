"""Personal data by candidate gradient boosting, in built-in column functions only.

Base spans follow fixed formats per kind. High-recall generators propose further spans, which may
overlap (disguised mail and network addresses, each long number as a phone and as a card). Format and
context features of every candidate are binned to small integers once, boosted trees score them, and a
candidate is added if it reaches its kind's threshold, touches no base span and beats the added
candidates that it touches.

The trees learn from ``examples``: strings whose kind is known from how they were made, in wordings
with and without personal data, disguised addresses and shapes that look alike on both sides. A quarter
of the wordings teaches nothing: on it the thresholds are calibrated to ``PRECISION`` per kind. A kind
that cannot reach it gets no additions. What is added depends on the text around a string alone, never
on the rest of the corpus, so one pass over the texts suffices, without any shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.llm import boosting
from attesta.llm.common import let, table, unused
from attesta.llm.examples import examples
from attesta.llm.spans import SPAN, joined, of_kind, sha256, spans

KINDS = ("email", "ip", "card", "phone")
PRECISION = 0.98

# Fixed formats, with possessive runs and a start that no earlier character could extend: the same
# leftmost matches, without trying a long run again from each of its characters, and without the
# recursion that a backtracking group would need for every repetition.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9]){15,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

# Generators. Of the two for mail the first lets white space stand around plain dots, the second does not.
LOOSE_EMAIL = r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?[\[(]?(?:@|\bat\b)[\])]?\x20?[A-Za-z0-9-]++(?:\x20?[\[(]?(?:\.|\bdot\b)[\])]?\x20?[A-Za-z0-9-]++)++"
TIGHT_EMAIL = r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?[\[(]?(?:@|\bat\b)[\])]?\x20?[A-Za-z0-9-]++(?:(?:\.|\x20?[\[(](?:\.|dot)[\])]\x20?|\x20dot\x20)[A-Za-z0-9-]++)++"
LOOSE_IP = r"(?<![0-9A-Za-z])[0-9]{1,3}+(?:\x20?[\[(]?\.[\])]?\x20?[0-9]{1,3}+){3}(?![0-9A-Za-z])"
LOOSE_NUMBER = r"(?<![0-9A-Za-z])[0-9(](?:[\x20().,/-]{0,2}+[0-9]){7,}+(?![0-9A-Za-z])"

#: Top-level labels: the general ones in wide use and those of countries.
TOP_LABELS = frozenset(
    "com org net edu gov mil int info biz name pro mobi arpa io ai app dev shop online site xyz tech cloud blog email store eu asia cat jobs tel travel museum aero coop "
    "ac ad ae af ag al am ao aq ar as at au aw ax az ba bb bd be bf bg bh bi bj bm bn bo br bs bt bv bw by bz ca cc cd cf cg ch ci ck cl cm cn co cr cu cv cw cx cy cz "
    "de dj dk dm do dz ec ee eg er es et fi fj fk fm fo fr ga gb gd ge gf gg gh gi gl gm gn gp gq gr gs gt gu gw gy hk hm hn hr ht hu id ie il im in iq ir is it "
    "je jm jo jp ke kg kh ki km kn kp kr kw ky kz la lb lc li lk lr ls lt lu lv ly ma mc md me mg mh mk ml mm mn mo mp mq mr ms mt mu mv mw mx my mz "
    "na nc ne nf ng ni nl no np nr nu nz om pa pe pf pg ph pk pl pm pn pr ps pt pw py qa re ro rs ru rw sa sb sc sd se sg sh si sj sk sl sm sn so sr ss st su sv sx sy sz "
    "tc td tf tg th tj tk tl tm tn to tr tt tv tw tz ua ug uk us uy uz va vc ve vg vi vn vu wf ws ye yt za zm zw".split()
)

# Words near a candidate: of its own kind, and of other things that look alike.
OWN_WORDS = {
    "email": r"(?i)(?:mail|contact|write|reach|address|ask|author|questions)",
    "ip": r"(?i)(?:\bip\b|host|addr|server|port|login|ping|from)",
    "card": r"(?i)(?:card|visa|amex|pay|credit|charge)",
    "phone": r"(?i)(?:phone|tel\b|tel\.|call|fax|mobile|dial|ring|reach|office|contact)",
}
OTHER_WORDS = r"(?i)(?:order|invoice|\bref|ticket|tracking|serial|item|isbn|book|version|section|chapter|release|dated|since|publish|population|inhabitant|visitor|people|euro|cost|worth|\bkm\b|total|rows|scores|results|[$€£%])"

def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    doubled = F.transform(
        F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""),
        lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)),
    )
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0


def _octets(match: Column) -> Column:
    return F.forall(F.split(match, r"\."), lambda p: p.rlike(r"^0*(?:[0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])$"))


def base_spans(text: Column) -> list[Column]:
    """Valid spans of each kind in order; ``text`` is never null."""
    cards = F.filter(spans("card", text, CARD), lambda s: F.length(_digits(s["match"])).between(16, 19) & luhn(_digits(s["match"])))
    phones = F.filter(spans("phone", text, PHONE, F.contains(text, F.lit("+"))), lambda s: F.length(_digits(s["match"])).between(8, 15))
    ips = F.filter(spans("ip", text, IP), lambda s: _octets(s["match"]))
    return [spans("email", text, EMAIL, F.contains(text, F.lit("@"))), ips, cards, phones]


def open_spans(text: Column) -> Column:
    """Candidates of the generators, overlapping and whatever they turn out to be."""
    # What every match of the mail patterns holds.
    signed = F.contains(text, F.lit("@")) | text.rlike(r"(?i)\bat\b")

    def read_as(kind: str, found: Column, least: int, most: int) -> Column:
        chosen = F.filter(found, lambda s: F.length(_digits(s["match"])).between(least, most))
        return F.transform(chosen, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["match"].alias("match")))

    numbers = let(spans("number", text, LOOSE_NUMBER), lambda n: F.concat(read_as("phone", n, 8, 15), read_as("card", n, 13, 19)))
    # Where the second mail pattern has a match the first has one too.
    mails = let(spans("email", text, LOOSE_EMAIL, signed), lambda m: F.when(F.size(m) == 0, m).otherwise(F.concat(m, spans("email", text, TIGHT_EMAIL))))
    return F.array_distinct(F.concat(mails, spans("ip", text, LOOSE_IP), numbers))


def features(text: Column, s: Column) -> list[Column]:
    """Small integers that describe candidate ``s`` and what stands around it; those of another kind are constant."""
    kind, match = s["kind"], s["match"]
    mail, number = kind == "email", kind != "email"
    ahead = F.substring(text, F.greatest(s["start"] - 23, F.lit(1)), F.least(s["start"], F.lit(24)))
    behind = F.substring(text, s["end"] + 1, F.lit(16))
    left, right = F.substring(text, s["start"], F.least(s["start"], F.lit(1))), F.substring(text, s["end"] + 1, F.lit(1))
    groups = F.filter(F.split(match, "[^0-9]+"), lambda g: g != "")
    size = F.transform(groups, lambda g: F.length(g))
    n = F.length(_digits(match))

    def flag(c: Column) -> Column:
        return F.coalesce(c, F.lit(False)).cast("int")

    def around(c: Column) -> Column:
        return F.when(c.rlike(r"^[\p{L}0-9]"), 2).when(c.rlike(r"^[+#@_=/$€-]"), 1).otherwise(0)

    def of_number(c: Column) -> Column:
        return F.when(number, c).otherwise(0).cast("int")

    def of_mail(c: Column) -> Column:
        return F.when(mail, c).otherwise(0).cast("int")

    separators = F.regexp_replace(match, "[0-9]", "")
    own = F.lit(False)
    for k, words in OWN_WORDS.items():
        own = F.when(kind == k, F.regexp_like(ahead, F.lit(words))).otherwise(own)
    date = r"^(?:(?:19|20)[0-9]{2}[-/.\x20]?(?:0[1-9]|1[0-2])[-/.\x20]?(?:0[1-9]|[12][0-9]|3[01])|(?:0[1-9]|[12][0-9]|3[01])[-/.\x20](?:0[1-9]|1[0-2])[-/.\x20](?:19|20)[0-9]{2}|(?:19|20)[0-9]{2}-(?:19|20)[0-9]{2}$)"
    return [
        F.array_position(F.array(*map(F.lit, KINDS)), kind).cast("int"),
        of_number(F.least(n, F.lit(20))),
        F.when(kind != "card", 2).when(luhn(_digits(match)), 1).otherwise(0),
        F.when(kind != "ip", 2).when(F.forall(groups, lambda g: g.cast("int") <= 255), 1).otherwise(0),
        of_number(F.least(F.size(groups), F.lit(9))),
        of_number(F.least(F.coalesce(F.get(size, F.lit(0)), F.lit(0)), F.lit(9))),
        of_number(F.least(F.coalesce(F.get(size, F.size(size) - 1), F.lit(0)), F.lit(9))),
        of_number(F.least(F.coalesce(F.array_max(size), F.lit(0)), F.lit(12))),
        of_number(
            F.when(separators == "", 0).when(separators.rlike(r"^\x20+$"), 1).when(separators.rlike(r"^\.+$"), 2).when(separators.rlike("^-+$"), 3).when(separators.rlike(r"^/+$"), 4).when(separators.rlike(","), 5).when(separators.rlike(r"[()]"), 6).otherwise(7)
        ),
        of_number(F.when(match.startswith("("), 3).when(match.startswith("00"), 2).when(match.startswith("0"), 1).otherwise(0)),
        of_number(flag((F.size(size) > 2) & (F.get(size, F.lit(0)) < 4) & F.forall(F.slice(size, 2, F.greatest(F.lit(1), F.size(size) - 2)), lambda g: g == 3))),
        of_number(flag(match.rlike(date))),
        of_number(flag(_digits(match).rlike("^97[89][0-9]{10}$"))),
        around(left),
        around(right),
        flag(own),
        flag(F.regexp_like(ahead, F.lit(OTHER_WORDS)) | F.regexp_like(behind, F.lit(OTHER_WORDS))),
        of_mail(flag(F.regexp_extract(F.lower(match), r"([a-z0-9-]+)$", 1).isin(sorted(TOP_LABELS)))),
        of_mail(F.when(match.rlike(r"(?i)[\[(](?:at|@)[\])]"), 3).when(match.rlike(r"@"), 2).otherwise(1)),
        of_mail(F.when(match.rlike(r"(?i)[\[(](?:\.|dot)[\])]"), 4).when(match.rlike(r"(?i)[^\x20]\x20dot\x20"), 3).when(match.rlike(r"\x20\.\x20"), 2).when(match.rlike(r"\.\x20|\x20\."), 1).otherwise(0)),
        of_mail(flag(match.rlike(r"^[A-Za-z]*[0-9._%+-]"))),
        of_mail(flag(match.rlike(r"[a-z].*\.\x20?[A-Z]"))),
        of_mail(F.least(F.length(F.regexp_extract(match, r"([A-Za-z0-9-]+)$", 1)), F.lit(6))),
    ]


def _whole(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def _described(text: Column, found: Column) -> Column:
    """The candidates ``found`` with their features ``f``, worked out once each."""
    return F.transform(found, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["match"].alias("match"), F.array(*features(text, s)).alias("f")))


def taught(spark: SparkSession) -> list[tuple[bool, str, tuple[int, ...], int, int]]:
    """(held out, kind, features, label, times) of all candidates in the examples, and under the kind's
    name with no features what was planted of it: (held out, kind, (), 1, times)."""
    made = examples()
    lines = "\n".join("\t".join((str(int(held)), text, kind, planted)) for held, text, kind, planted in made)
    part = F.split("line", "\t")
    rows = spark.range(1).select(F.explode(F.split(F.lit(lines), "\n")).alias("line")).select(part[0].alias("held"), part[1].alias("text"), part[2].alias("kind"), part[3].alias("planted"))
    fresh = let(open_spans(F.col("text")), lambda o: _described(F.col("text"), F.filter(o, lambda s: ~F.exists(F.concat(*base_spans(F.col("text"))), lambda b: _touches(s, b)))))
    found = (
        rows.select("held", "kind", "planted", F.explode(fresh).alias("c"))
        .select("held", F.col("c.kind").alias("found"), "c.f", ((F.col("c.kind") == F.col("kind")) & (F.col("c.match") == F.col("planted"))).cast("int").alias("y"))
        .groupBy("held", "found", "f", "y").count().collect()
    )
    out = [(r["held"] == "1", r["found"], tuple(r["f"]), r["y"], r["count"]) for r in found]
    for kind in KINDS:
        out += [(held, kind, (), 1, sum(h == held and k == kind for h, _, k, _ in made)) for held in (False, True)]
    return sorted(out)


def fit(spark: SparkSession, precision: float = PRECISION) -> tuple[list, dict[str, float]]:
    """(trees, threshold per kind), the same for every corpus."""
    rows = [r for r in taught(spark) if r[2]]
    learn = [r for r in rows if not r[0]]
    trees = boosting.fit([r[2] for r in learn], [r[3] for r in learn], [float(r[4]) for r in learn])
    limits = {}
    for kind in KINDS:
        found = boosting.calibrated([(boosting.total(trees, f), y, float(w)) for held, k, f, y, w in rows if held and k == kind], precision)
        if found is not None:
            limits[kind] = max(found, 0.0)
    return trees, limits


def measured(spark: SparkSession) -> dict[str, tuple[float, float]]:
    """Kind -> (precision, recall) of added spans on the wordings held out from the trees, before overlaps are settled."""
    (trees, limits), rows, out = fit(spark), taught(spark), {}
    for kind, least in limits.items():
        kept = [(y, w) for held, k, f, y, w in rows if held and k == kind and f and boosting.total(trees, f) >= least]
        planted = sum(w for held, k, f, _, w in rows if held and k == kind and not f)
        good, every = sum(w for y, w in kept if y), sum(w for _, w in kept)
        out[kind] = (good / every if every else 1.0, good / planted if planted else 1.0)
    return out


def _touches(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def added_spans(text: Column, base: Column, model) -> Column:
    """Candidates at or over their kind's threshold that touch no base span; of two that touch each other, taken by
    start, the one with the higher score stays. One pass over base spans and candidates in order of start."""
    trees, limits = model
    if not limits:
        return F.array().cast(SPAN)
    item = "struct<start:int,rank:int,end:int,score:double,kind:string,match:string>"

    def entry(s: Column, rank: int, score: Column) -> Column:
        return F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), score.alias("score"), s["kind"].alias("kind"), s["match"].alias("match")).cast(item)

    def scored(found: Column) -> Column:
        return F.transform(_described(text, found), lambda s: entry(s, 1, boosting.expression(trees, [F.get(s["f"], F.lit(i)) for i in range(N_FEATURES)])))

    def reaches(s: Column) -> Column:
        least = F.lit(float("inf"))
        for kind, at in limits.items():
            least = F.when(s["kind"] == kind, F.lit(at)).otherwise(least)
        return s["score"] >= least

    def step(acc: Column, s: Column) -> Column:
        is_base, held = s["rank"] == 0, acc["last"].isNotNull()
        clash = held & (acc["last"]["end"] > s["start"])
        skip = ~is_base & (s["start"] < acc["reach"])
        nothing = F.lit(None).cast(item)
        return F.struct(
            F.when(held & ~skip & ~clash, F.concat(acc["out"], F.array(acc["last"]))).otherwise(acc["out"]).alias("out"),
            F.when(is_base, nothing).when(skip | (clash & (s["score"] <= acc["last"]["score"])), acc["last"]).otherwise(s).alias("last"),
            F.when(is_base, F.greatest(acc["reach"], s["end"])).otherwise(acc["reach"]).alias("reach"),
        )

    def settled(kept: Column) -> Column:
        start = F.struct(F.array().cast(f"array<{item}>").alias("out"), F.lit(None).cast(item).alias("last"), F.lit(0).alias("reach"))
        ordered = F.array_sort(F.concat(F.transform(base, lambda b: entry(b, 0, F.lit(0.0))), kept))
        out = F.aggregate(ordered, start, step, lambda acc: F.when(acc["last"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(acc["last"]))))
        return F.transform(out, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["match"].alias("match")))

    none = F.array().cast(SPAN)
    return let(open_spans(text), lambda found: F.when(F.size(found) == 0, none).otherwise(let(F.filter(scored(found), reaches), lambda kept: F.when(F.size(kept) == 0, none).otherwise(settled(kept)))))


N_FEATURES = 23


def _by_kind(found: Column) -> Column:
    """In order of kind as listed, then start."""
    return F.concat(*[F.array_sort(of_kind(found, k)) for k in KINDS])


def find(documents: DataFrame, model=None) -> DataFrame:
    """``documents`` with ``base`` and ``added`` (arrays of kind, start, end, match); ``model`` is that of ``fit`` by default.

    Null text counts as empty and has no spans. Repeated rows and documents with equal texts each get
    the same spans; an empty table gives an empty result; other columns pass through, but for some named
    ``base`` or ``added`` in any letter case, which the new ones replace. Offsets are code points, end
    exclusive. Long texts are searched whole.
    """
    model = fit(documents.sparkSession) if model is None else model
    documents = documents.drop(*[c for c in documents.columns if c.lower() in ("base", "added")])
    text, name = _whole(F.col("text")), unused(documents, "found")
    found = let(text, lambda t: let(F.concat(*base_spans(t)), lambda b: F.struct(b.alias("base"), added_spans(t, b, model).alias("added"))))
    return documents.withColumn(name, found).select("*", F.col(name)["base"].alias("base"), F.col(name)["added"].alias("added")).drop(name)


def redacted(text: Column, found: Column) -> Column:
    """``text`` with each span (overlapping ones together) replaced by its kind in brackets; null stays null."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    ordered = F.array_sort(F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def step(acc: Column, s: Column) -> Column:
        open_text = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], open_text).otherwise(acc["out"]).alias("out"))

    whole = F.aggregate(ordered, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(found) == 0, text).otherwise(whole)


def redact(documents: DataFrame, model=None) -> DataFrame:
    """``documents`` with the same columns, personal data in ``text`` replaced by its kind; ``n_chars``, if there, follows.

    Null and empty texts stay as they are, repeated rows are redacted alike, an empty table stays empty and
    all other columns pass through whatever their names.
    """
    model = fit(documents.sparkSession) if model is None else model
    text = F.col("text")
    new = let(F.concat(*base_spans(text)), lambda b: redacted(text, F.concat(b, added_spans(text, b, model))))
    out = documents.withColumn("text", F.when(text.isNotNull(), new))
    return out.withColumn("n_chars", F.length("text").cast(documents.schema["n_chars"].dataType)) if "n_chars" in documents.columns else out


def op2_pii(spark, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    counts = [F.size(of_kind(F.col("base"), k)).cast("long").alias(f"n_{k}") for k in KINDS]
    return find(documents).select("doc_id", *counts, sha256(joined(F.col("base"))).alias("base_sha256"), joined(_by_kind(F.concat("base", "added"))).alias("spans"))
