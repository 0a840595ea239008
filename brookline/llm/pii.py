"""Personal data by bootstrapped contextual extraction; DataFrame and SQL functions alone.

Base entities (e-mail, IP address, payment card, phone) are found by their forms. They are the seeds, and so is a part of the tokens of
a key's form (KEY: 20 letters and digits in a row or more, at least four of either; of those, the ones whose MD5 begins
with a digit of SEED_DIGITS, half of them, so that the other half shows what the contexts find). An instance is a seed or any other
token with a digit, an @ or a _ that overlaps no base entity. Its contexts are lexical patterns of three sorts: the two
words before it, the two words after it, and the word on either side; in patterns, a word with a digit, an @ or a _ stands
as 0, and so does every other entity of the same kind. Texts' ends count as no word.

On the graph of patterns and instances, a pattern's support is the number of its seeds and half of that of its instances which trusted
patterns found; instances that nothing is known of count neither for nor against it. Against it are its counter-instances:
ordinary words that stand in that very context anywhere in the corpus, and plain numbers (PLAIN: figures and signs with
fewer than seven figures). Its confidence is support / (support + counter-instances + 1), so a few seeds weigh less than many. A pattern
with a support of MIN_SEEDS and that CONFIDENCE is trusted: tokens in its place are found, as identifiers of kind "id",
without the signs around them. Found instances support further patterns, round after round, until no pattern becomes
trusted; support only grows, so that ends, and more than ROUNDS rounds are an error.

Ordinary words in a context are counted in a pass over all words joined with a table of patterns: first of those with at least
MIN_SEEDS seeds, then, where what is found gives others such a support, of those; no other pattern could be trusted. A pass over one text in SOME
comes before: a pattern that stands before so many ordinary words there that it could not be trusted if all its instances
were seeds (a common pair of words, mostly) need not be counted in the rest. That changes no result. Spans are in code points, end exclusive. Places are sums of the lengths of the
pieces between matches, made by doubling; look-behinds and possessive quantifiers keep the expressions linear on long runs
and give the same matches as the plain forms below.

Defined results: a null or empty text has no spans; a null doc_id stays null; rows that repeat get the same spans each;
an empty table gives an empty table; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

KINDS = ("email", "ip", "card", "phone", "id")
ROUNDS, FOUND, MIN_SEEDS, CONFIDENCE, SOME, SEED_DIGITS = 40, 0.5, 3, 0.6, 16, "01234567"

#: Plain forms: email [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+   ip [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
#: card [0-9]([\x20-]?[0-9])+   phone \+[0-9][\x20().0-9-]+[0-9]
FORMS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Plain form: [^\x20\x09-\x0D0-9@_]*[0-9@_][^\x20\x09-\x0D]*
TOKEN = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@_]*+[0-9@_][^\x20\x09-\x0D]*+"
KEY, SPACE = "[A-Za-z0-9]{20,}", r"[\x20\x09-\x0D]+"
#: A plain number: figures and signs alone, fewer than seven figures (values are in lower case and begin and end with a letter or figure).
PLAIN = "rlike(v, '^[^a-z@_]+$') and length(regexp_replace(v, '[^0-9]', '')) < 7"
#: The last two words (or one) of a text, and the first two, with the white space on the near side.
LAST_TWO = r"(?<![^\x20\x09-\x0D])(?:[^\x20\x09-\x0D]++[\x20\x09-\x0D]++)?[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+\z"
FIRST_TWO = r"^[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++(?:[\x20\x09-\x0D]++[^\x20\x09-\x0D]++)?"
ITEM = "struct<s:int,e:int,v:string,seed:boolean,c:array<string>>"
MAY_HOLD = {"email": "contains(text, '@')", "ip": "rlike(text, '[0-9][.][0-9]')", "card": "rlike(text, '[0-9]{2}|[0-9][ -][0-9]')", "phone": "contains(text, '+')", "token": "rlike(text, '[0-9@_]')"}
PASSES = {
    "email": "true",
    "ip": "forall(split(m, '[.]'), p -> coalesce(try_cast(p as int) <= 255, false))",
    "card": "length(regexp_replace(m, '[ -]', '')) between 12 and 19 and luhn_check(regexp_replace(m, '[ -]', ''))",
    "phone": "length(regexp_replace(m, '[^0-9]', '')) between 9 and 15",
    "token": "true",
}
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _quoted(pattern: str) -> str:
    return "r'" + pattern.replace("'", r"\x27") + "'"


def _let(name: str, value: str, then: str) -> str:
    """SQL in which `name` stands for a value that is computed once."""
    return f"element_at(transform(array({value}), {name} -> {then}), 1)"


def _running(array: str, op: str) -> str:
    """SQL for the running op(x, y) of an array, by doubling: n log n steps, nothing copied per element."""
    return f"aggregate(sequence(0, 30), {array}, (a, k) -> if(shiftleft(1, k) >= size(a), a, transform(a, (x, i) -> if(i >= shiftleft(1, k), {op.format(x='x', y='get(a, i - shiftleft(1, k))')}, x))))"


def _words(text: str) -> str:
    """SQL for the words of a text as patterns have them."""
    return f"transform(filter(split({text}, {_quoted(SPACE)}, -1), w -> w <> ''), w -> if(rlike(w, '[0-9@_]'), '0', translate(w, '{UPPER}', '{LOWER}')))"


#: The patterns of an instance from the words before it (bw) and after it (aw), nearest ones inward.
_PATTERNS = """filter(array(
    if(size(bw) >= 2, concat('< ', bw[size(bw) - 2], ' ', bw[size(bw) - 1]), null),
    if(size(aw) >= 2, concat('> ', aw[0], ' ', aw[1]), null),
    if(size(bw) >= 1 and size(aw) >= 1, concat('= ', bw[size(bw) - 1], ' ', aw[0]), null)), c -> c is not null)"""


def _places(kind: str, pattern: str) -> str:
    """SQL for the array of ITEM structs of a kind's matches that pass: place, value, whether a seed, and patterns."""
    q, token = _quoted(pattern), kind == "token"
    before = "concat(coalesce(concat(get(ts, i - 2), ' 0 '), ''), coalesce(concat(get(ts, i - 1), ' 0 '), ''), ts[i])"
    after = "concat(hs[i + 1], coalesce(concat(' 0 ', get(hs, i + 2)), ''), coalesce(concat(' 0 ', get(hs, i + 3)), ''))"
    value = r"regexp_replace(regexp_replace(m, r'^[^A-Za-z0-9]++', ''), r'(?<=[A-Za-z0-9])[^A-Za-z0-9]++\z', '')" if token else "m"
    lead = "length(regexp_extract(m, r'^[^A-Za-z0-9]*+', 0))" if token else "0"
    seed = f"length(regexp_replace(regexp_extract(m, '{KEY}', 0), '[^0-9]', '')) >= 4 and length(regexp_replace(regexp_extract(m, '{KEY}', 0), '[0-9]', '')) >= 4 and rlike(md5(cast(translate(v, '{UPPER}', '{LOWER}') as binary)), '^[{SEED_DIGITS}]')" if token else "true"
    item = _let("bw", _words(before), _let("aw", _words(after), _let("v", value, f"named_struct('s', ends[i] - length(m) + {lead}, 'e', ends[i] - length(m) + {lead} + length(v), 'v', translate(v, '{UPPER}', '{LOWER}'), 'seed', {seed}, 'c', {_PATTERNS})")))
    made = f"transform(ms, (m, i) -> if({PASSES[kind]}, {item}, cast(null as {ITEM})))"
    with_ends = _let("ends", _running("transform(ms, (m, i) -> length(ps[i]) + length(m))", "{x} + {y}"), f"filter({made}, x -> x is not null and x.v <> '')")
    tails = f"transform(ps, p -> regexp_extract(p, {_quoted(LAST_TWO)}, 0))"
    heads = f"transform(ps, p -> regexp_extract(p, {_quoted(FIRST_TWO)}, 0))"
    body = _let("ts", tails, _let("hs", heads, with_ends))
    none = f"cast(array() as array<{ITEM}>)"
    found = _let("ms", f"regexp_extract_all(text, {q}, 0)", f"if(size(ms) = 0, {none}, {_let('ps', f'split(text, {q}, -1)', body)})")
    return f"if({MAY_HOLD[kind]}, {found}, {none})"


def base_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, mark, n_email .. n_phone, base, seeds, tokens) in arrays in order of place; seeds has the values and
    patterns of base, tokens the other instances."""
    out = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    out = out.select("doc_id", "text", *[F.expr(_places(k, p)).alias(k) for k, p in (FORMS | {"token": TOKEN}).items()])
    base = "array_sort(concat(" + ", ".join(f"transform({k}, x -> named_struct('s', x.s, 'k', {i + 1}, 'e', x.e))" for i, k in enumerate(FORMS)) + "))"
    seeds = "transform(concat(" + ", ".join(FORMS) + "), x -> named_struct('v', x.v, 'c', x.c))"
    out = out.select("doc_id", F.xxhash64("text").alias("mark"), *[F.size(k).cast("long").alias(f"n_{k}") for k in FORMS], F.expr(base).alias("base"), F.expr(seeds).alias("seeds"), "token")
    # Tokens apart from base entities: of all in order of place, no entity before one reaches into it, none starts within it.
    order = "array_sort(concat(transform(base, x -> named_struct('s', x.s, 't', 0, 'e', x.e, 'at', 0)), transform(token, (x, i) -> named_struct('s', x.s, 't', 1, 'e', x.e, 'at', i))))"
    reach = _running("transform(al, x -> if(x.t = 0, x.e, 0))", "greatest({x}, {y})")
    ahead = f"reverse({_running('transform(reverse(al), x -> if(x.t = 0, x.s, 2147483647))', 'least({x}, {y})')})"
    apart = _let("al", order, _let("far", reach, _let("nxt", ahead, "transform(filter(transform(al, (x, i) -> struct(x.t as t, x.at as at, far[i] <= x.s and nxt[i] >= x.e as apart)), y -> y.t = 1 and y.apart), y -> token[y.at])")))
    return out.withColumn("tokens", F.expr(f"if(size(base) = 0 or size(token) = 0, token, {apart})")).drop("token")


def counter_words(docs: DataFrame, patterns: DataFrame, text_col: str = "text") -> DataFrame:
    """Rows (c, against): how many different ordinary words stand in the place of a pattern; without end, where it is settled
    early that they are too many. patterns: a table of c and count, the number of its instances."""
    plain = f"regexp_replace(translate(btrim(coalesce({text_col}, ''), ' \t\n\x0b\f\r'), '{UPPER}', '{LOWER}'), {_quoted(TOKEN)}, '0')"
    # Each word beside its neighbours: the list five times, shifted, so that a row holds five words and never the list.
    beside = "inline(arrays_zip(concat(array(null, null), w), concat(array(null), w), w, slice(w, 2, size(w)), slice(w, 3, size(w))))"
    sorts = "array(concat('< ', p2, ' ', p1), concat('> ', n1, ' ', n2), concat('= ', p1, ' ', n1))"

    def against(rows: DataFrame, wanted: DataFrame) -> DataFrame:
        words = rows.select(F.expr(f"split({plain}, {_quoted(SPACE)}, -1)").alias("w"))
        each = words.selectExpr(beside).toDF("p2", "p1", "x", "n1", "n2").where("x <> '0'")
        met = each.select("x", F.explode(F.expr(sorts)).alias("c")).where("c is not null").join(wanted.select("c"), "c")
        return met.distinct().groupBy("c").agg(F.count("*").cast("double").alias("against"))

    first = patterns.join(against(docs.where(F.pmod(F.xxhash64(text_col), F.lit(SOME)) == 0), patterns), "c", "left")
    best = F.col("count") / (F.col("count") + F.coalesce("against", F.lit(0.0)) + 1)
    first = written(first.select("c", (best >= CONFIDENCE).alias("open")), "first_counts")
    full = against(docs, first.where("open"))
    return first.join(full, "c", "left").select("c", F.when(F.col("open"), F.coalesce("against", F.lit(0.0))).otherwise(float("inf")).alias("against"))


def trusted_patterns(edges: DataFrame, count: Callable[[DataFrame], DataFrame], rounds: int = ROUNDS, min_seeds: int = MIN_SEEDS) -> DataFrame:
    """edges (c, v, seed): distinct pairs of pattern and instance, a table that is cheap to read again. count(patterns) gives,
    for rows (c, count), the ordinary words in their place (c, against). Rows (c, support, confidence) of the trusted patterns."""
    support, known, good, n_good = edges.groupBy("c").agg(F.sum("seed").alias("support")), None, None, 0
    for _ in range(rounds):
        # Of a known size, so that a small table is broadcast. Instances and plain numbers are counted along.
        open_ = support.where(F.col("support") >= min_seeds)
        sized = edges.groupBy("c").agg(F.count("*").alias("count"), F.count_if(F.expr(PLAIN) & (F.col("seed") == 0)).alias("plain"))
        now = written(open_.join(sized, "c"), "supports")
        new = now if known is None else now.join(known, "c", "left_anti")
        if known is None or new.take(1):
            counted = written(count(new.select("c", "count")), "counted")
            known = counted if known is None else written(known.unionByName(counted), "known")
        confidence = F.col("support") / (F.col("support") + F.col("against") + F.col("plain") + 1)
        good = written(now.join(known, "c").select("c", "support", confidence.alias("confidence")).where(F.col("confidence") >= CONFIDENCE), "trusted")
        n = good.count()
        if n == n_good:
            return good
        n_good = n
        found = edges.where("seed = 0").join(good.select("c"), "c", "left_semi").select("v").distinct().withColumn("found", F.lit(FOUND))
        support = edges.join(found, "v", "left").groupBy("c").agg(F.sum(F.greatest("seed", F.coalesce("found", F.lit(0.0)))).alias("support"))
    raise RuntimeError(f"patterns did not settle in {rounds} rounds")


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (all), n_id (what
    the patterns add), n_spans."""
    base = written(base_spans(docs, id_col, text_col), "pii")
    seen = base.select("doc_id", "mark", F.explode("tokens").alias("t")).select("doc_id", "mark", "t.s", "t.e", "t.v", F.col("t.seed").cast("double").alias("seed"), F.explode("t.c").alias("c"))
    seeds = base.select(F.explode("seeds").alias("t")).select("t.v", F.explode("t.c").alias("c"))
    edges = seeds.select("c", "v", F.lit(1.0).alias("seed")).union(seen.select("c", "v", "seed")).groupBy("c", "v").agg(F.max("seed").alias("seed"))
    often = edges.groupBy("c").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_SEEDS).select("c")
    edges = written(edges.join(often, "c"), "edges")  # a pattern of fewer instances can never be trusted
    good = trusted_patterns(edges, lambda patterns: counter_words(docs, patterns, text_col)).select("c")
    new = seen.join(good, "c").groupBy("doc_id", "mark").agg(F.collect_set(F.struct("s", F.lit(5).alias("k"), "e")).alias("new"))
    joined = base.alias("b").join(new.alias("n"), F.col("b.doc_id").eqNullSafe(F.col("n.doc_id")) & (F.col("b.mark") == F.col("n.mark")), "left")
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    written_out = f"array_join(transform(%s, x -> concat(element_at({names}, x.k), ':', x.s, ':', x.e)), ',')"
    every = joined.select("b.*", F.coalesce("n.new", F.expr("cast(array() as array<struct<s:int,k:int,e:int>>)")).alias("new"))
    return every.select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone",
        F.sha2(F.expr(written_out % "base").cast("binary"), 256).alias("base_sha256"),
        F.expr(written_out % "array_sort(concat(base, new))").alias("spans"),
        F.size("new").cast("long").alias("n_id"),
        (F.size("base") + F.size("new")).cast("long").alias("n_spans"),
    )
