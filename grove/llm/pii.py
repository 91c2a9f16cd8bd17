"""Personal data: exact patterns, and weak supervision for secrets that no pattern fixes. DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grove.llm.common import free_name, keep

#: Possessive repeats and look-behinds change no match of the plain patterns, but keep long runs linear.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone", "secret", "account", "name", "address")
#: Candidates of the added kinds: long runs of key characters with a digit in them; runs of digits and capitals as
#: accounts, passports and identity numbers have them; capitalised words in a row; a number and a capitalised way or one
#: with its number behind.
CANDIDATES = {
    "secret": r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*+[0-9])[A-Za-z0-9+/_=-]{16,}+",
    "account": r"(?<![A-Za-z0-9+/_=.-])(?=[A-Z0-9 -]{7})[A-Z]{0,2}[0-9](?:[ -]?[A-Z0-9]){5,32}+(?![A-Za-z0-9+/_=@])",
    "name": r"(?<![\p{L}\p{N}])\p{Lu}\p{Ll}++ (?:\p{Lu}\. )?\p{Lu}\p{Ll}++(?:-\p{Lu}\p{Ll}++)?(?![\p{L}\p{N}])",
    "address": r"(?<![\p{L}\p{N}])(?:[0-9]{1,5}[a-z]?,? (?:rue|avenue|boulevard|place|calle|avenida|\p{Lu}\p{Ll}++)(?: \p{L}\p{Ll}*+){1,3}|\p{Lu}\p{Ll}++(?:straße|strasse|gasse|weg|allee|platz) [0-9]{1,4}[a-z]?)(?![\p{L}\p{N}])",
}
#: What must be in a text before its candidates of a kind are looked for.
HINTS = {"secret": r"[0-9]", "account": r"[0-9][A-Z0-9 -]{5}", "name": r"\p{Lu}\p{Ll}+ (?:\p{Lu}\. )?\p{Lu}", "address": r"[0-9]"}
#: Words before (or in) a candidate that speak for its kind.
GAZETTEERS = {
    "secret": ("token", "secret", "password", "passwd", "pwd", "api", "apikey", "key", "auth", "bearer", "credential", "credentials", "session", "private", "access"),
    "account": ("account", "acct", "iban", "konto", "compte", "cuenta", "passport", "passeport", "pasaporte", "reisepass", "ssn", "social", "security", "license", "licence", "tax", "vat", "nif", "dni", "member", "customer", "patient", "id", "no", "nr", "number"),
    "name": ("mr", "mrs", "ms", "dr", "prof", "herr", "frau", "monsieur", "madame", "señor", "señora", "name", "named", "contact", "dear", "signed", "sincerely", "regards", "author", "employee", "patient"),
    "address": ("address", "lives", "living", "resides", "street", "adresse", "wohnhaft", "habite", "domicile", "dirección", "vive", "ship", "mail", "at"),
}
FIRST_NAMES = ("james", "john", "robert", "michael", "david", "william", "mary", "patricia", "jennifer", "linda", "elizabeth", "susan", "anna", "maria", "peter", "thomas", "hans", "klaus", "julia", "laura", "pierre", "jean", "marie", "sophie", "carlos", "juan", "josé", "carmen", "luis", "ana")
WAYS = "(?i)(?:street|st|road|rd|avenue|ave|lane|ln|drive|dr|boulevard|blvd|square|court|way|rue|place|calle|avenida|plaza|straße|strasse|gasse|weg|allee|platz)\\b"
NEAR = 24
LABELERS = 5


#: Matches that are put together at a time, see found().
_RUN = 64
_SPANS = "array<struct<kind:string,start:int,end:int,found:string>>"


def found(text: Column, pattern: str, kind: str, hint: Column) -> Column:
    """Leftmost non-overlapping matches as an array of ``kind, start, end, found``; offsets in code points.

    What lies between matches (the split) and the matches themselves add up to the offsets. Arrays can only grow by being
    copied, so runs of _RUN matches get offsets of their own, the runs are put behind one another, and offsets are moved
    by where their run starts: few copies even with many thousand matches.
    """
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size(hits)), hits, lambda g, h: F.struct(g.alias("gap"), h.alias("hit")))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["hit"])
        span = F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), x["hit"].alias("found"))
        return F.struct(end.alias("at"), F.concat(acc["spans"], F.array(span)).alias("spans"))

    def behind(acc: Column, run: Column) -> Column:
        return F.struct((acc["at"] + run["at"]).alias("at"), F.concat(acc["runs"], F.array(F.struct(acc["at"].alias("from"), run["spans"].alias("spans")))).alias("runs"))

    def moved(run: Column) -> Column:
        place = lambda s: F.struct(s["kind"].alias("kind"), (s["start"] + run["from"]).alias("start"), (s["end"] + run["from"]).alias("end"), s["found"].alias("found"))
        return F.transform(run["spans"], place)

    def placed(all_pairs: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(all_pairs), F.lit(1)), F.lit(_RUN))
        runs = F.transform(starts, lambda i: F.aggregate(F.slice(all_pairs, i, F.lit(_RUN)), F.expr(f"struct(0 AS at, cast(array() AS {_SPANS}) AS spans)"), step))
        return F.aggregate(runs, F.expr(f"struct(0 AS at, cast(array() AS array<struct<from:int,spans:{_SPANS}>>) AS runs)"), behind, lambda a: F.flatten(F.transform(a["runs"], moved)))

    # a variable for the pairs, which would otherwise be sought anew for each run
    return F.when(hint, F.element_at(F.transform(F.array(pairs), placed), 1)).otherwise(F.expr(f"cast(array() AS {_SPANS})"))


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    doubled = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).when(d.cast("int") > 4, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0


def base_spans(text: Column) -> Column:
    """Emails, addresses of four parts up to 255, card numbers that pass Luhn's test, international phone numbers."""
    byte = lambda p: F.length(F.ltrim(p, F.lit("0"))) <= 3
    small = lambda p: F.when(byte(p), F.coalesce(F.ltrim(p, F.lit("0")).try_cast("int"), F.lit(0)) <= 255).otherwise(False)
    return F.concat(
        found(text, EMAIL, "email", F.contains(text, F.lit("@"))),
        F.filter(found(text, IP, "ip", text.rlike(IP)), lambda s: F.forall(F.split(s["found"], r"\."), small)),
        F.filter(found(text, CARD, "card", text.rlike(r"[0-9](?:[\x20-]?[0-9]){13}")), lambda s: F.when(F.length(_digits(s["found"])).between(14, 19), _luhn(_digits(s["found"]))).otherwise(False)),
        F.filter(found(text, PHONE, "phone", F.contains(text, F.lit("+"))), lambda s: F.length(_digits(s["found"])).between(10, 15)),
    )


def candidates(text: Column, base: Column) -> Column:
    """What may be an added span and overlaps no base span, with the text ``before`` and the characters ``after`` it."""
    over = lambda s: lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])
    more = F.concat(*(found(text, pattern, kind, text.rlike(HINTS[kind])) for kind, pattern in CANDIDATES.items()))
    # a variable for the base spans, which would otherwise be sought anew for each candidate
    spans = F.element_at(F.transform(F.array(base), lambda own: F.filter(more, lambda s: ~F.exists(own, over(s)))), 1)
    start = lambda s: F.greatest(s["start"] - NEAR, F.lit(0))
    return F.transform(spans, lambda s: s.withField("before", F.substring(text, start(s) + 1, s["start"] - start(s))).withField("after", F.substring(text, s["end"] + 1, F.lit(2))))


def _of_kind(c: Column, by: dict[str, Column]) -> Column:
    out = F.lit(1)
    for kind, says in by.items():
        out = F.when(c["kind"] == kind, says).otherwise(out)
    return out


def votes(c: Column) -> list[Column]:
    """What each labeler says of a candidate: 2 personal, 0 not, 1 nothing.

    Two regex labelers look at its form, one gazetteer at the words before it and one at those in it, two at its context.
    """
    run, before = c["found"], F.lower(c["before"])
    digits = F.length(_digits(run)) / F.length(run)
    near = F.split(before, r"[^\p{L}]+")
    named = {k: F.when(F.exists(near, lambda w: w.isin(*words)), 2).otherwise(0 if k in ("name", "address") else 1) for k, words in GAZETTEERS.items()}  # noqa: B023
    assigned = before.rlike("[=:]\\s*[\"'`]?$")
    quoted = before.rlike("[\"'`]$") & F.left(c["after"], F.lit(1)).isin('"', "'", "`")
    plain = before.rlike(r"(^|[.!?\n]\s?)$")
    first = F.lower(F.element_at(F.split(run, " "), 1)).isin(*FIRST_NAMES)
    return [
        _of_kind(c, {
            "secret": F.when(run.rlike("^(?:[0-9a-f]{20,}|[0-9A-F]{20,})$"), 2).when(run.rlike("[a-z]") & run.rlike("[A-Z]") & run.rlike("[0-9].*[0-9]"), 2).when(run.rlike("^[0-9-]+$"), 0).otherwise(1),
            "account": F.when(run.rlike("^[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,}") | run.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$") | run.rlike("^[A-Z]{1,2}[0-9]{6,8}$") | run.rlike("^[3-6][0-9]{3}(?:[ -]?[0-9]{4}){3}$"), 2).otherwise(0),
            "name": F.when(first, 2).otherwise(1),
            "address": F.when(run.rlike(WAYS), 2).otherwise(0),
        }),
        _of_kind(c, {
            "secret": F.when(digits.between(0.1, 0.9), 2).otherwise(0), "account": F.when(F.length(_digits(run)) >= 6, 2).otherwise(0),
            "name": F.when(plain | (F.element_at(F.split(run, " "), 1) == F.element_at(F.split(run, " "), -1)), 0).otherwise(1), "address": F.when(c["after"].rlike(r"^,? ?[0-9\p{Lu}]"), 2).otherwise(1),
        }),
        _of_kind(c, named),
        F.when(assigned, 2).otherwise(0),
        F.when(quoted, 2).when(before.rlike("[\\s]$") & c["after"].rlike("^\\s?"), F.when(c["kind"] == "secret", 0).otherwise(1)).otherwise(1),
    ]


def pattern_of(says: list[Column], kind: Column) -> Column:
    """A number for the votes and the kind."""
    code = F.array_position(F.lit(list(CANDIDATES)), kind).cast("int") - 1
    for v in says:
        code = code * 3 + v
    return code


def features(c: Column) -> list[Column]:
    """Few-valued features of a span for the final classifier, each with the span's kind."""
    run, before = c["found"], F.lower(c["before"])
    shape = F.when(run.rlike("^[0-9a-fA-F]+$"), "hex").when(run.rlike("^[0-9-]+$"), "digits").when(run.rlike("[+/_=-]"), "signs").when(run.rlike(WAYS), "way").otherwise("letters")
    word = F.regexp_extract(before, r"(\p{L}+)[^\p{L}]*$", 1)
    listed = F.exists(F.lit(sorted({w for ws in GAZETTEERS.values() for w in ws})), lambda w: w == word)
    some = lambda x: F.pmod(F.crc32(x), F.lit(64)).cast("string")  # noqa: E731  one of 64 values, whatever the script
    parts = {
        "length": F.least(F.floor(F.length(run) / 8), F.lit(12)).cast("string"), "shape": shape, "share": F.floor(10 * F.length(_digits(run)) / F.length(run)).cast("string"),
        "left": some(F.regexp_replace(F.right(before, F.lit(1)), r"\p{L}", "a")), "right": some(F.regexp_replace(F.lower(F.left(c["after"], F.lit(1))), r"\p{L}", "a")), "word": F.when(listed, word).otherwise(some(word)),
        "first": F.lower(F.element_at(F.split(run, " "), 1)).isin(*FIRST_NAMES).cast("string"),
    }
    return [F.concat_ws(":", c["kind"], F.lit(name), x) for name, x in parts.items()]


def reliabilities(counts: dict[int, int], rounds: int = 60) -> list[float]:
    """Expectation-maximisation over vote patterns; the probability of a secret for each of the 3 ** LABELERS patterns.

    Each labeler has its own chances of saying no, nothing or yes for secrets and for the rest; labelers are taken as
    independent given the truth. It starts from the share of yes among votes; without a yes nothing is personal.
    """
    cells = [[p // 3 ** (LABELERS - 1 - j) % 3 for j in range(LABELERS)] for p in range(3**LABELERS)]
    post = [0.02 + 0.96 * (s.count(2) / max(1, len(s) - s.count(1))) if len(s) > s.count(1) else 0.5 for s in cells]
    if not counts:
        return post
    total = sum(counts.values())
    for _ in range(rounds):
        prior = (sum(n * post[p] for p, n in counts.items()) + 1) / (total + 2)
        says = [[[0.5, 0.5, 0.5] for _ in range(2)] for _ in range(LABELERS)]
        for j in range(LABELERS):  # the starting counts lean to labelers being right more often than not
            says[j][1][2] += 1.5
            says[j][0][0] += 1.5
            for p, n in counts.items():
                says[j][1][cells[p][j]] += n * post[p]
                says[j][0][cells[p][j]] += n * (1 - post[p])
        odds = lambda s: math.log(prior / (1 - prior)) + sum(math.log(says[j][1][v] / sum(says[j][1])) - math.log(says[j][0][v] / sum(says[j][0])) for j, v in enumerate(s))  # noqa: B023, E731
        post = [1 / (1 + math.exp(-max(-50.0, min(50.0, odds(s))))) if 2 in s else 0.0 for s in cells]
    return post


def classifier(seen: DataFrame) -> tuple[dict[str, float], dict[str, float]]:
    """A naive Bayes span classifier fitted to the labelers' joint opinion: a bias for each kind, a weight for each feature value.

    ``seen`` has ``pattern`` and ``features`` of all candidates. The labelers' reliabilities are estimated for each kind
    by itself. What reaches the driver is bounded: counts of vote patterns and of feature values, of which there are few
    whatever the input.
    """
    counts = {r["pattern"]: r["count"] for r in seen.groupBy("pattern").count().collect()}
    cells = 3**LABELERS
    post, bias, totals = [], {}, {}
    for i, kind in enumerate(CANDIDATES):
        own = {p - i * cells: n for p, n in counts.items() if p // cells == i}
        post += (mine := reliabilities(own))
        yes = sum(n * mine[p] for p, n in own.items())
        totals[kind] = yes, sum(own.values()) - yes
        bias[kind] = math.log((yes + 1) / (totals[kind][1] + 1))
    sums = seen.select(F.element_at(F.lit(post), F.col("pattern") + 1).alias("p"), F.explode("features").alias("f")).groupBy("f").agg(F.sum("p").alias("yes"), F.sum(1 - F.col("p")).alias("no")).collect()
    weights = {}
    for r in sums:
        yes, no = totals[r["f"].split(":")[0]]
        weights[r["f"]] = math.log((r["yes"] + 0.5) / (yes + 1)) - math.log((r["no"] + 0.5) / (no + 1))
    return bias, weights


def personal_data(docs: DataFrame, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """``docs`` with ``spans``: an array of ``kind, start, end, found`` by start, then kind as in KINDS.

    Base spans are exact. Added ones are candidates that the classifier gives a probability of at least ``least`` and some labeler says yes to; it
    learns from five labelers' votes over all candidates of the corpus, whose reliabilities are estimated by
    expectation-maximisation for each kind. Candidates may overlap each other. The table is read twice, nothing is
    shuffled but counts. A null text has no spans; every row is judged by itself; an empty table gives an empty result;
    all columns stay, and if there is one named ``spans``, the new one is ``spans_``.
    """
    text, name = F.coalesce(F.col(text_col), F.lit("")), free_name(docs, "spans")
    base, more = free_name(docs, "_base"), free_name(docs, "_more")
    rows = docs.withColumn(base, base_spans(text)).withColumn(more, candidates(text, F.col(base)))
    some = rows.where(F.size(more) > 0).select(F.explode(more).alias("c"))
    seen = keep(some.select(pattern_of(votes(F.col("c")), F.col("c.kind")).alias("pattern"), F.array(*features(F.col("c"))).alias("features")))
    bias, weights = classifier(seen)
    as_map = lambda d: F.create_map(*(F.lit(x) for kv in d.items() for x in kv)) if d else F.expr("cast(map() AS map<string,double>)")
    table, start = as_map(weights), as_map(bias)
    score = lambda c: F.element_at(start, c["kind"]) + sum((F.coalesce(F.element_at(table, f), F.lit(0.0)) for f in features(c)), F.lit(0.0))
    plain = lambda s: F.struct(*(s[x].alias(x) for x in ("kind", "start", "end", "found")))
    added = F.transform(F.filter(more, lambda c: F.array_contains(F.array(*votes(c)), 2) & (score(c) >= math.log(least / (1 - least)))), plain)
    order = lambda s: F.array_position(F.lit(list(KINDS)), s["kind"])
    by = lambda a, b: F.when(a["start"] != b["start"], F.when(a["start"] < b["start"], -1).otherwise(1)).when(order(a) != order(b), F.when(order(a) < order(b), -1).otherwise(1)).otherwise(0)
    return rows.withColumn(name, F.array_sort(F.concat(base, added), by)).drop(base, more)


def masked(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in angle brackets; of overlapping spans the first names the whole."""

    def step(acc: Column, s: Column) -> Column:
        inside = s["start"] < acc["at"]
        piece = F.concat(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit("<"), F.upper(s["kind"]), F.lit(">"))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(inside, acc["out"]).otherwise(F.concat(acc["out"], piece)).alias("out"))

    whole = F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, whole).otherwise(text)


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
