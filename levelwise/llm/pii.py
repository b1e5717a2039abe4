"""Personal data: pattern detection, and terms that give a protected entity away.

Patterns find e-mail addresses, IP addresses, card and phone numbers; these and secrets (long runs of
letters and digits, as keys and tokens are) are protected. Values rarely repeat, so an entity is looked
at on a ladder: the value, the group it belongs to (mail domain, network, issuer, dialling prefix), the kind.

The information-theoretic part asks what their surroundings reveal. An entity c tells IC(c) =
-log2 p(c) bits; a term t near it gives PMI(c; t) = log2 p(c | t) / p(c) of them away. Probabilities are
shares of the distinct texts of the corpus; t is near c within ``REACH`` words; p(c | t) is taken at the lower
end of its confidence interval (Wilson), so that few texts prove little. A term that makes an entity
likelier than not (``LIKELY``) discloses it: with a PMI of ``REMOVE`` times IC it is removed wherever it
occurs, from ``GENERALISE`` times on it is generalised to its kind of token.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from levelwise.llm.common import bind, identity, stored, text_of, words_of

#: Words on either side of an entity that count as its surroundings.
REACH = 8
#: An entity in fewer distinct texts is looked at on the next rung of its ladder only.
SUPPORT = 3
GENERALISE, REMOVE = 0.8, 0.95
#: Least p(c | t) of a term that discloses, and one-sided 95 % of the normal distribution for its bound.
LIKELY, NORMAL = 0.5, 1.645
#: Parts of the texts (one in so many) in which candidate terms are counted before they are in all of them.
PARTS = (16, 4)
#: Characters before and after an entity that mostly hold its nearest words.
STRETCH = 400

KINDS = ("email", "ip", "card", "phone")
#: Kinds that the method adds, after those.
ADDED = ("secret", "term")
SECRET, TERM = len(KINDS), len(KINDS) + 1

# Fixed rules of the four kinds. Each is the plain pattern with possessive loops and a
# bound on where a match may start; neither changes which leftmost matches there are, both
# keep a long run of digits or letters from being scanned again from each character.
_EMAIL = (
    r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
)
_IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = r"[0-9](?:[\x20-]?[0-9])++"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: A secret: 20 or more letters and digits in a row, four digits and a letter among them.
_SECRET = r"(?<![A-Za-z0-9])[A-Za-z0-9]{20,}+"
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"


def running_sums(values: Column) -> Column:
    """Inclusive prefix sums of an array, in a doubling of steps instead of a loop."""
    rounds = F.ceil(F.log2(F.greatest(F.size(values), F.lit(1)))).cast("int")
    strides = F.transform(F.sequence(F.lit(0), rounds), lambda r: F.pow(F.lit(2), r).cast("int"))
    return F.aggregate(
        strides,
        values,
        lambda sums, by: F.transform(
            sums, lambda x, i: x + F.coalesce(F.get(sums, i - by), F.lit(0))
        ),
    )


def matches(text: Column, pattern: Column) -> Column:
    """Leftmost non-overlapping matches as an array of (start, end, found), in code points.

    The text between matches and the matches themselves alternate, so positions are
    prefix sums of their lengths.
    """
    none = F.array().cast("array<struct<start:int,end:int,found:string>>")

    def steps(found: Column) -> Column:
        return bind(
            F.split(text, pattern, -1),
            lambda gaps: F.transform(
                found, lambda m, i: F.char_length(F.get(gaps, i)) + F.char_length(m)
            ),
        )

    def placed(found: Column) -> Column:
        return bind(
            running_sums(steps(found)),
            lambda ends: F.transform(
                found,
                lambda m, i: F.struct(
                    (F.get(ends, i) - F.char_length(m)).alias("start"),
                    F.get(ends, i).alias("end"),
                    m.alias("found"),
                ),
            ),
        )

    return bind(
        F.regexp_extract_all(text, pattern, 0),
        lambda found: F.when(F.size(found) == 0, none).otherwise(placed(found)),
    )


def _digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether a number passes the Luhn sum: every second digit from the right is doubled."""
    each = F.transform(
        F.split(F.reverse(digits), ""),
        lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(
            F.when(d.cast("int") > 4, 2 * d.cast("int") - 9).otherwise(2 * d.cast("int"))
        ),
    )
    return F.aggregate(each, F.lit(0), lambda a, b: a + b) % 10 == 0


def _kept(kind: str, found: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return found.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    n = F.length(_digits(found))
    if kind == "phone":
        return n.between(10, 15)
    return F.when(n.between(14, 19), _luhn(_digits(found))).otherwise(F.lit(False))


def _passes(kind: str, match: Column) -> Column:
    return _kept(kind, match["found"])


def _tagged(kind: int, spans: Column) -> Column:
    return F.transform(
        spans,
        lambda m: F.struct(
            m["start"].alias("start"),
            F.lit(kind).alias("kind"),
            m["end"].alias("end"),
            m["found"].alias("found"),
        ),
    )


def _number_of(kind: int) -> Column:
    return F.size(F.filter("base", lambda b: b["kind"] == kind)).cast("long")


def entity_spans(text: Column) -> dict[str, Column]:
    """For each kind an array of (start, end, found): the base matches of a text."""
    patterns = {"email": _EMAIL, "ip": _IP, "card": _CARD, "phone": _PHONE}
    # A mark without which a kind cannot match spares most texts the pattern.
    marks = {"email": "@", "ip": ".", "card": None, "phone": "+"}
    out = {}
    for kind, pattern in patterns.items():
        found = F.filter(matches(text, F.lit(pattern)), partial(_passes, kind))
        mark = marks[kind]
        if mark:
            none = F.array().cast("array<struct<start:int,end:int,found:string>>")
            found = F.when(F.contains(text, F.lit(mark)), found).otherwise(none)
        out[kind] = found
    return out


def secret_spans(text: Column, base: Column) -> Column:
    """(start, end, found) of the secrets of a text that touch no base span."""
    none = F.array().cast("array<struct<start:int,end:int,found:string>>")
    kept = F.filter(
        matches(text, F.lit(_SECRET)),
        lambda m: m["found"].rlike("[A-Za-z]")
        & m["found"].rlike("(?:[^0-9]*[0-9]){4}")
        & ~F.exists(base, lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])),
    )
    return F.when(text.rlike("[A-Za-z0-9]{20}"), kept).otherwise(none)


def _rungs(kind: Column, found: Column) -> Column:
    """The ladder of an entity as hashes: its value, its group if it has one, its kind."""
    group = (
        F.when(kind == 0, F.substring_index(F.lower(found), "@", -1))
        .when(kind == 1, F.substring_index(found, ".", 3))
        .when(kind == 2, F.substring(_digits(found), 1, 6))
        .when(kind == 3, F.substring(_digits(found), 1, 4))
    )
    rungs = [F.xxhash64(F.lit(i), kind, v) for i, v in enumerate((found, group, F.lit("")))]
    return F.array_compact(F.array(rungs[0], F.when(group.isNotNull(), rungs[1]), rungs[2]))


def _nearest(whole: Column, start: Column, end: Column) -> Column:
    """The ``REACH`` words before and after a span, whatever their lengths."""

    def near(short: Column, cut: Column, full: Column) -> Column:
        # Beyond REACH words the one that the stretch cuts is not among the nearest.
        return bind(
            short, lambda w: F.when(cut & (F.size(w) <= REACH), words_of(full)).otherwise(w)
        )

    before = near(
        words_of(F.substring(whole, F.greatest(start - (STRETCH - 1), F.lit(1)), F.least(start, F.lit(STRETCH)))),
        start > STRETCH,
        F.substring(whole, F.lit(1), start),
    )
    after = near(
        words_of(F.substring(whole, end + 1, F.lit(STRETCH))),
        F.char_length(whole) > end + STRETCH,
        F.substring(whole, end + 1, F.char_length(whole)),
    )
    return F.concat(F.slice(F.reverse(before), 1, REACH), F.slice(after, 1, REACH))


def likelihood_bound(hits: Column, of: Column) -> Column:
    """Lower end of the Wilson interval of a share."""
    p, z2 = hits / of, NORMAL**2
    return (p + z2 / (2 * of) - NORMAL * F.sqrt(p * (1 - p) / of + z2 / (4 * of * of))) / (1 + z2 / of)


def with_entities(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """Columns of ``keep``, ``whole`` (the text, null as empty), ``row`` and ``base``.

    ``base`` is an array of (start, kind, end, found), sorted; ``kind`` counts KINDS from 0.
    """
    # The kind columns are plain expressions over ``whole``; each is used once below.
    slim = docs.select(*keep, text_of(text).alias("whole"))
    tagged = [_tagged(k, spans) for k, spans in enumerate(entity_spans(F.col("whole")).values())]
    return slim.select("*", F.array_sort(F.concat(*tagged)).alias("base"))


def _texts_with(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """``term`` of ``wanted`` and ``with_term``, the distinct texts that hold it; terms of no text are absent."""
    spread = texts.select(
        F.xxhash64("whole").alias("t"), F.explode(F.array_distinct(words_of(F.col("whole")))).alias("term")
    ).join(wanted, F.col("term") == F.col("wanted"), "left_semi")
    return spread.distinct().groupBy("term").agg(F.count("*").alias("with_term"))


def _wanted_terms(both: DataFrame, texts: DataFrame, parts: tuple[int, ...] = PARTS) -> DataFrame:
    """``wanted``, the terms of ``both`` (with column ``both``) that may still be likely enough.

    A term is in at least as many texts as in a part of them, and its bound falls with their number. So
    the words of every text drop out in a part of the texts, and only rare ones are counted in all; no term
    that discloses is lost.
    """
    wanted = stored(both.groupBy(F.col("term").alias("wanted")).agg(F.max("both").alias("most")), "wanted-terms")
    for part in parts:
        some = texts.where(F.pmod(F.xxhash64("whole"), F.lit(part)) == 0)
        counted = wanted.join(_texts_with(some, wanted), F.col("wanted") == F.col("term"), "left")
        least = F.greatest("most", F.coalesce("with_term", F.lit(0)))
        likely = counted.where(likelihood_bound(F.col("most"), least) >= LIKELY)
        wanted = stored(likely.select("wanted", "most"), "wanted-terms")
    return wanted.select("wanted")


def disclosing_terms(
    found: DataFrame,
    texts: DataFrame,
    support: int = SUPPORT,
    generalise: float = GENERALISE,
    remove: float = REMOVE,
) -> DataFrame:
    """Terms that give an entity away: ``term`` and ``removed`` (else generalised).

    ``found`` has ``whole`` and a non-empty ``base`` (secrets included) per text, ``texts`` has ``whole`` of
    the entire corpus. Pairs are (rung of an entity, word near it), at most ``2 * REACH`` words for each
    occurrence, never all entities of a text with all its words. Copies of a text count once; words
    without a letter or digit tell nothing.
    """
    spots = found.select(F.xxhash64("whole").alias("t"), F.explode("base").alias("b"), "whole")
    spots = spots.select(
        "t",
        _rungs(F.col("b.kind"), F.col("b.found")).alias("rungs"),
        F.array_distinct(_nearest(F.col("whole"), F.col("b.start"), F.col("b.end"))).alias("terms"),
    )
    spots = stored(spots, "entity-surroundings")
    # A bounded number of rows for each occurrence; distinct combines map-side.
    rungs = spots.select("t", F.explode("rungs").alias("entity"), "terms")
    entities = rungs.select("t", "entity").distinct().groupBy("entity").agg(F.count("*").alias("with_entity"))
    entities = entities.where(F.col("with_entity") >= support)
    pairs = rungs.select("t", "entity", F.explode("terms").alias("term")).where(F.col("term").rlike(r"[\p{L}\p{N}]"))
    both = pairs.distinct().groupBy("entity", "term").agg(F.count("*").alias("both"))
    # A term of no other text than these has the greatest bound; where that is too low no count is needed.
    both = both.where(likelihood_bound(F.col("both"), F.col("both")) >= LIKELY)
    both = stored(both.join(entities, "entity"), "near-terms")
    terms = _texts_with(texts, _wanted_terms(both, texts))
    total = float(texts.select(F.xxhash64("whole").alias("t")).distinct().count())
    likely = likelihood_bound(F.col("both"), F.col("with_term"))
    ic = F.log2(F.lit(total) / F.col("with_entity"))
    bits = both.join(terms, "term").select("term", likely.alias("likely"), ic.alias("ic"))
    pmi = F.log2("likely") + F.col("ic")
    told = bits.where((F.col("ic") > 0) & (F.col("likely") >= LIKELY) & (pmi >= generalise * F.col("ic")))
    return told.groupBy("term").agg(F.max(pmi >= remove * F.col("ic")).alias("removed"))


def term_spans(texts: DataFrame, terms: DataFrame, keep: list[str]) -> DataFrame:
    """For texts that hold disclosing terms: ``keep`` and ``terms``.

    ``terms`` is an array of (start, end, found, removed). Words are looked up in the term
    table by a join; the few texts that hold any are then searched with a pattern of
    their own terms.
    """
    own = texts.select(
        F.col("row").alias("r"), F.explode(F.array_distinct(words_of(F.col("whole")))).alias("w")
    )
    held = (
        own.join(terms, F.col("w") == F.col("term"))
        .groupBy("r")
        .agg(F.array_sort(F.collect_set(F.struct("term", "removed"))).alias("held"))
    )
    quoted = lambda h: F.regexp_replace(h["term"], r"([^\p{L}\p{N}_])", r"\\$1")
    # A term is matched as a whole word, so the order of the alternatives is free.
    pattern = F.concat(
        F.lit(r"(?<![^\x20\x09-\x0D])(?:"),
        F.array_join(F.transform("held", quoted), "|"),
        F.lit(r")(?![^\x20\x09-\x0D])"),
    )
    held = stored(held.select("r", "held", pattern.alias("pattern")), "term-patterns")
    joined = texts.join(held, F.col("row") == F.col("r"))
    marked = F.transform(
        matches(F.col("whole"), F.col("pattern")),
        lambda m: F.struct(
            m["start"],
            m["end"],
            m["found"],
            F.exists("held", lambda h: (h["term"] == m["found"]) & h["removed"]).alias("removed"),
        ),
    )
    return joined.select(*keep, marked.alias("terms"))


def find_personal_data(docs: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """``doc_id``, ``row``, ``base``, ``secrets`` and ``terms`` of every document.

    ``base`` is sorted; ``secrets`` touch no base span, ``terms`` neither these nor secrets. Null
    texts are empty; repeated rows stay; an empty table gives an empty result.
    """
    keep = docs.select(
        F.col(id_column).alias("doc_id"),
        text_of(text).alias("whole"),
        identity(id_column, text).alias("row"),
    )
    rows = with_entities(keep, ["doc_id", "row"], "whole")
    rows = rows.withColumn("secrets", secret_spans(F.col("whole"), F.col("base")))
    # Only texts with an entity are kept beside their spans.
    some = F.when((F.size("base") > 0) | (F.size("secrets") > 0), F.col("whole")).alias("whole")
    light = stored(rows.select("doc_id", "row", "base", "secrets", some), "entities")
    every = F.concat("base", _tagged(SECRET, F.col("secrets"))).alias("base")
    found = light.where("whole is not null").select("whole", every)
    terms = stored(disclosing_terms(found, keep), "disclosing-terms")
    spans = term_spans(keep, terms, ["row"]).select(F.col("row").alias("r"), "terms")
    # Repeated rows have equal spans: one of them is enough for the join.
    spans = spans.groupBy("r").agg(F.first("terms").alias("terms"))
    joined = light.join(spans, F.col("row") == F.col("r"), "left")
    none = F.array().cast("array<struct<start:int,end:int,found:string,removed:boolean>>")
    touches = lambda m: lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])
    clear = lambda m: ~F.exists("base", touches(m)) & ~F.exists("secrets", touches(m))
    return joined.select(
        "doc_id", "row", "base", "secrets", F.filter(F.coalesce("terms", none), clear).alias("terms")
    )


def sanitise(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` with personal data replaced.

    Entities become ``[EMAIL]``, ``[SECRET]`` and so on, removed terms go, generalised ones become
    ``[NUMBER]``, ``[NAME]`` or ``[WORD]`` by their look.
    """
    found = find_personal_data(docs).select("row", "base", "secrets", "terms").dropDuplicates(["row"])
    label = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    kind = lambda t: (
        F.when(t.rlike("[0-9]"), "[NUMBER]").when(t.rlike(r"^\p{Lu}"), "[NAME]").otherwise("[WORD]")
    )
    put = F.array_sort(
        F.concat(
            F.transform("base", lambda b: F.struct(b["start"], b["end"], F.get(label, b["kind"]).alias("put"))),
            F.transform("secrets", lambda m: F.struct(m["start"], m["end"], F.lit("[SECRET]").alias("put"))),
            F.transform(
                "terms",
                lambda m: F.struct(
                    m["start"], m["end"], F.when(m["removed"], "").otherwise(kind(m["found"])).alias("put")
                ),
            ),
        )
    )
    # Base spans of two kinds may overlap; of the text between labels nothing is repeated.
    own = docs.select(
        "doc_id", text_of("text").alias("whole"), identity("doc_id", "text").alias("r")
    )
    joined = own.join(found.select("row", put.alias("put")), F.col("r") == F.col("row"))
    between = F.transform(
        "put",
        lambda p, i: bind(
            F.coalesce(F.array_max(F.transform(F.slice("put", 1, i), lambda q: q["end"])), F.lit(0)),
            lambda at: F.concat(
                F.substring("whole", at + 1, F.greatest(p["start"] - at, F.lit(0))), p["put"]
            ),
        ),
    )
    last = F.coalesce(F.array_max(F.transform("put", lambda p: p["end"])), F.lit(0))
    rest = F.substring("whole", last + 1, F.char_length("whole"))
    return joined.select("doc_id", F.concat(F.array_join(between, ""), rest).alias("text"))


def personal_data(docs: DataFrame) -> DataFrame:
    """Counts by kind and spans of every document.

    A null text is empty and has none; repeated rows stay; an empty table gives an empty result; other
    columns are not read.
    """
    found = find_personal_data(docs)
    name = F.array(*[F.lit(k) for k in KINDS + ADDED])
    merged = F.array_sort(
        F.concat(
            F.transform("base", lambda b: F.struct(b["start"].alias("start"), b["kind"].alias("kind"), b["end"].alias("end"))),
            *[
                F.transform(c, lambda m, k=k: F.struct(m["start"].alias("start"), F.lit(k).alias("kind"), m["end"].alias("end")))
                for k, c in ((SECRET, "secrets"), (TERM, "terms"))
            ],
        )
    )
    text = lambda spans: F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"], s["end"])), ","
    )
    return found.select(
        "doc_id",
        *[_number_of(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)],
        F.sha2(text(F.col("base")), 256).alias("base_sha256"),
        text(merged).alias("spans"),
    )
