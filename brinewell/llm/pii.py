"""Personal data by bootstrapped contextual extraction, in DataFrame functions only.

Seeds are the e-mail addresses, IP addresses, card and phone numbers that fixed
expressions find, and, with a lower prior, tokens that look like keys. The
tokens around an entity are its lexical patterns: the token before it, the two
before it (so ``key =`` is one), and the token after it. Patterns and
identifier-shaped tokens form a bipartite graph that is scored in rounds. A
pattern's score is the share of its occurrences in the corpus that are next to
an identifier, each weighed by how sure it is one; copies of a page count on
both sides of that share. An identifier is as likely as the sound patterns
around it make it. What a round discovers counts as a seed in the next one, so
patterns that only stand next to discovered identifiers are found too.
Identifiers next to a sound pattern become spans.

Places are prefix sums over the pieces between matches, made in blocks, so the
work on a text grows with its length and not with its square.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brinewell.functions.arrays import let, replaced, scan, sums
from brinewell.plans.lineage import cut, small

#: Kinds in the order in which spans at one place are listed.
KINDS = ("email", "ip", "card", "phone", "id")
#: Fixed expressions, leftmost and non-overlapping. Possessive repeats and the
#: look-behind only save time: they let no search start inside a run that has failed.
_EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = r"[0-9](?:[\x20-]?[0-9])++"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Stands for base spans where tokens are sought; a private character that is no part of a token.
_FILL = ""
#: Characters between tokens; a token also ends after = and :.
_GAP = r"\s\x22'(\["
#: Tokens with a digit or an at sign that could be identifiers.
_TOKEN = rf"(?<![^{_GAP}=:])(?=[A-Za-z._+/-]*+[0-9@])[A-Za-z0-9][A-Za-z0-9._@+/-]{{4,}}+(?!{_FILL})"
_PARTS = rf"[{_GAP}]++|(?<=[=:])(?=[^{_GAP}])"
#: The last two tokens of a reversed text, and the first token after the one that an entity ends in.
_BACK = rf"(?:[=:][^{_GAP}=:]*+|[^{_GAP}=:]++)"
_LEFT = rf"^[{_GAP}]*+({_BACK})(?:[{_GAP}]*+({_BACK}))?"
_RIGHT = rf"^[^{_GAP}]*+[{_GAP}]++([^{_GAP}=:]*+[=:]|[^{_GAP}=:]++)"
#: Tokens that look like keys: so many letters and digits, both among them; how likely they are identifiers by themselves.
_KEYLIKE, KEY_PRIOR = r"^(?=.*[0-9])(?=.*[A-Za-z])[A-Za-z0-9_+/-]{32,}$", 0.75

#: Distinct seeds that a pattern must stand next to, rounds of scoring, and the scores that patterns and identifiers need.
MIN_SUPPORT, ROUNDS, MIN_PATTERN, MIN_IDENTIFIER = 3, 3, 0.5, 0.5

_SPAN = "array<struct<start:int,kind:int,end:int,value:string,contexts:array<string>>>"


def _contexts(values: Column, pieces: Column, i: Column) -> Column:
    """The patterns around the i-th match, ``1 token``, ``2 token token`` and ``r token``, in lower case."""
    no = F.lit("")
    at = lambda a, k: F.coalesce(F.get(a, k), no)
    before = F.reverse(F.lower(F.concat(at(values, i - 2), at(pieces, i - 1), at(values, i - 1), at(pieces, i))))
    after = F.lower(F.concat(at(pieces, i + 1), at(values, i + 1)))

    def keys(left: Column) -> Column:
        one, two = F.reverse(left[0]), F.reverse(left[1])
        right = F.regexp_extract(after, _RIGHT, 1)
        named = F.array(F.when(one != "", F.concat(F.lit("1 "), one)), F.when(two != "", F.concat(F.lit("2 "), two, F.lit(" "), one)), F.when(right != "", F.concat(F.lit("r "), right)))
        return F.array_compact(named)

    return let(before, lambda b: let(F.array(F.regexp_extract(b, _LEFT, 1), F.regexp_extract(b, _LEFT, 2)), keys))


def _spans(text: Column, pattern: str, kind: int, valid: Callable[[Column], Column] | None = None) -> Column:
    """All matches that are valid, with their places in code points."""

    def build(values: Column, pieces: Column) -> Column:
        ends = sums(F.transform(values, lambda v, i: F.length(v) + F.length(pieces[i])))
        drop = F.lit(False)

        def span(v: Column, i: Column, e: Column) -> Column:
            return F.struct((e[i] - F.length(v)).alias("start"), F.lit(kind).alias("kind"), e[i].alias("end"), v.alias("value"), _contexts(values, pieces, i).alias("contexts"))

        ok = (lambda v: F.coalesce(valid(v), drop)) if valid else (lambda v: F.lit(True))
        return let(ends, lambda e: F.array_compact(F.transform(values, lambda v, i: F.when(ok(v), span(v, i, e))))).cast(_SPAN)

    none = F.array().cast(_SPAN)
    some = (lambda m: F.exists(m, valid)) if valid else (lambda m: F.size(m) > 0)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return let(found, lambda m: F.when(F.coalesce(some(m), F.lit(False)), let(F.split(text, pattern, -1), lambda p: build(m, p))).otherwise(none))


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def value(i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda s, i: s + value(i)) % 10 == 0


def _valid_card(m: Column) -> Column:
    digits = F.regexp_replace(m, "[ -]", "")
    return F.when(F.length(digits).between(14, 19), _luhn(digits)).otherwise(False)


def _valid_ip(m: Column) -> Column:
    def part(p: Column) -> Column:
        bare = F.regexp_replace(p, "^0+", "")
        return F.when(F.length(bare) <= 3, F.coalesce(F.nullif(bare, F.lit("")).cast("int"), F.lit(0)) <= 255).otherwise(False)

    return F.forall(F.split(m, r"\."), part)


def _valid_phone(m: Column) -> Column:
    return F.length(F.regexp_replace(m, "[^0-9]", "")).between(10, 15)


def base_spans(text: Column) -> list[Column]:
    """The spans of each fixed expression, those that fail their check left out."""
    none = F.array().cast(_SPAN)
    return [
        F.when(F.contains(text, F.lit("@")), _spans(text, _EMAIL, 0)).otherwise(none),
        F.when(F.contains(text, F.lit(".")), _spans(text, _IP, 1, _valid_ip)).otherwise(none),
        _spans(text, _CARD, 2, _valid_card),
        F.when(F.contains(text, F.lit("+")), _spans(text, _PHONE, 3, _valid_phone)).otherwise(none),
    ]


def _runs(spans: Column) -> Column:
    """Runs ``(start, kind, end)`` of overlapping spans, which are sorted by start; a run has the kind of its first span."""

    def build(s: Column, top: Column) -> Column:
        last = F.size(s) - 1
        heads = F.filter(F.sequence(F.lit(0), last), lambda i: (i == 0) | (s[i]["start"] >= F.get(top, i - 1)))
        return let(heads, lambda h: F.transform(h, lambda i, j: F.struct(s[i]["start"].alias("start"), s[i]["kind"].alias("kind"), top[F.coalesce(F.get(h, j + 1) - 1, last)].alias("end"))))

    some = let(spans, lambda s: let(scan(F.transform(s, lambda x: x["end"]), F.greatest), lambda top: build(s, top)))
    return F.when(F.size(spans) > 0, some).otherwise(F.array().cast("array<struct<start:int,kind:int,end:int>>"))


def mask(text: Column, spans: Column) -> Column:
    """``text`` with each span, or run of overlapping spans, replaced by its kind in angle brackets; ``spans`` are sorted by start."""
    names = F.array(*(F.lit(f"<{k.upper()}>") for k in KINDS))
    return replaced(text, _runs(spans), lambda r: names[r["kind"]])


def _totals(text: Column, docs: DataFrame, keys: DataFrame) -> DataFrame:
    """``(key, total)``: how often each pattern's tokens occur in all texts, one after the other where there are two."""
    words = F.filter(F.split(F.lower(text), _PARTS, -1), lambda w: w != "")
    pairs = docs.select(words.alias("w")).select(F.explode(F.transform("w", lambda x, i: F.struct(x.alias("token"), F.get("w", i - 1).alias("prior")))).alias("s")).select("s.*")
    ended = keys.select("key", F.substring("key", 1, 1).alias("shape"), F.substring_index("key", " ", -1).alias("token"))
    met = (F.col("shape") == "1") | (F.col("prior").isNotNull() & ((F.col("shape") == "r") | (F.col("key") == F.concat(F.lit("2 "), "prior", F.lit(" "), "token"))))
    return pairs.join(small(ended), "token").where(met).groupBy("key").agg(F.count("*").alias("total"))


def discover(occurrences: DataFrame, docs: DataFrame, text: Column) -> tuple[DataFrame, DataFrame] | None:
    """Sound patterns ``(key, score)`` and identifiers ``(value, chance)``; None where no pattern has support.

    ``occurrences``: ``(value, prior, contexts)``, one row for each occurrence
    of a seed (prior over 0) or of another token that could be an identifier.
    """
    apart = occurrences.select("value", "prior", F.explode("contexts").alias("key"))
    seeds = cut(apart.where("prior > 0").groupBy("key", "value").agg(F.max("prior").alias("prior"), F.count("*").alias("n")), "seed_edges")
    others = apart.where("prior = 0").select("key", "value")
    patterns = known = totals = None
    for _ in range(ROUNDS):
        strong, weak = seeds, others
        if known is not None:
            fresh = small(known)
            more = others.join(fresh, "value").groupBy("key", "value").agg(F.max("chance").alias("prior"), F.count("*").alias("n"))
            strong = seeds.join(fresh, "value", "left").select("key", "value", F.greatest("prior", "chance").alias("prior"), "n").union(more.select("key", "value", "prior", "n"))
            weak = others.join(fresh, "value", "left_anti").select("key", "value")
        strong = cut(strong, "strong_edges")
        backed = cut(strong.groupBy("key").agg(F.count("*").alias("kinds"), F.min("prior").alias("least")).where(F.col("kinds") >= MIN_SUPPORT), "backed")
        unsure = weak.join(small(backed.select("key")), "key").groupBy("key", "value").agg(F.count("*").alias("n"))
        edges = cut(strong.join(small(backed.select("key")), "key").select("key", "value", "prior", "n").union(unsure.select("key", "value", F.lit(0.0), "n")), "edges")
        # Patterns that stand next to sure seeds alone can discover nothing and needn't be scored.
        keys = cut(edges.where("prior < 1").select("key").distinct(), "keys")
        new = keys if totals is None else cut(keys.join(totals, "key", "left_anti"), "new_keys")
        if not new.isEmpty():
            more = _totals(text, docs, new)
            totals = cut(more if totals is None else totals.union(more), "totals")
        if totals is None:
            return None
        sums = edges.join(small(keys), "key").groupBy("key").agg(F.sum(F.col("prior") * F.col("n")).alias("good"), F.sum("n").alias("n"))
        scores = sums.join(totals, "key").select("key", (F.col("good") / F.greatest("total", "n")).alias("score"))
        patterns = cut(scores.where(F.col("score") >= MIN_PATTERN), "patterns")
        doubt = F.sum(F.log1p(-F.least("score", F.lit(0.999))))
        heard = edges.where("prior < 1").join(small(patterns), "key").groupBy("value").agg((1 - F.exp(doubt)).alias("heard"), F.max("prior").alias("prior"))
        known = cut(heard.select("value", F.greatest("heard", "prior").alias("chance")).where(F.col("chance") >= MIN_IDENTIFIER), "identifiers")
        if known.isEmpty():
            break
    return patterns, known


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, base, spans)``, one row per row of ``docs``.

    ``base`` and ``spans`` are arrays of ``(start, kind, end, value, contexts)``,
    in code points, end exclusive, kind an index of KINDS, sorted by start then
    kind; ``spans`` holds the base spans and those that the patterns discover,
    which overlap none of them.

    Null texts count as empty. Repeated rows and ids, null ids included, each
    give their row. An empty table gives no rows. Other columns, of whatever
    name, are not read.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    source = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), text.alias("text"))
    kinds = base_spans(F.col("text"))
    scanned = source.select("*", *(k.alias(f"kind{i}") for i, k in enumerate(kinds)))
    scanned = scanned.select("row", "id", "text", F.array_sort(F.concat(*(f"kind{i}" for i in range(4)))).alias("base"))
    scanned = scanned.withColumn("rest", replaced(F.col("text"), _runs(F.col("base")), lambda r: F.repeat(F.lit(_FILL), r["end"] - r["start"])))
    scanned = cut(scanned.select("row", "id", "base", _spans(F.col("rest"), _TOKEN, 4).alias("tokens")), "scanned")

    def occurrences(spans: str, prior: Column) -> DataFrame:
        return scanned.select(F.explode(spans).alias("s")).select(F.lower("s.value").alias("value"), prior.alias("prior"), "s.contexts")

    keylike = F.when(F.col("value").rlike(_KEYLIKE), KEY_PRIOR).otherwise(0.0)
    every = occurrences("base", F.lit(1.0)).union(occurrences("tokens", F.lit(0.0)).withColumn("prior", keylike))
    found = discover(every, docs, text)
    if found is None:
        return scanned.select("id", "base", F.col("base").alias("spans"))
    patterns, known = found
    fresh = scanned.select("row", F.explode("tokens").alias("s")).select("row", "s", F.lower("s.value").alias("value"), F.explode("s.contexts").alias("key"))
    fresh = fresh.join(small(patterns), "key").join(small(known), "value")
    more = fresh.groupBy("row").agg(F.array_distinct(F.collect_list("s")).alias("more"))
    both = F.array_sort(F.concat("base", F.coalesce("more", F.array().cast(_SPAN))))
    return scanned.select("row", "id", "base").join(more, "row", "left").select("id", "base", both.alias("spans"))


def span_list(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")
