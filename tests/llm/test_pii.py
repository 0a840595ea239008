"""Personal data against the plain forms, and the bootstrapping on a planted context."""

import hashlib
import re
import time

from brookline.llm import pii

FORMS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def passes(kind, m):
    digits = re.sub("[^0-9]", "", m)
    return {"email": True, "ip": all(int(p) <= 255 for p in m.split(".")) if kind == "ip" else 0, "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]


def brute(text):
    spans = [(m.start(), i, k, m.end()) for i, (k, p) in enumerate(FORMS.items()) for m in re.finditer(p, text or "", re.ASCII) if passes(k, m[0])]
    counts = [sum(s[2] == k for s in spans) for k in FORMS]
    return counts, ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(spans))


ODD = [
    None, "", "no data", "a.b+c@mail.example.com", "x@y@z.com a@b.c_d@e.f %@q.r..s a@b", "é😀 me@host-1.org, 😀 +1 (017) 555-7713.",
    "1.2.3.4 1.2.3.4.5.6.7.8 256.1.1.1 0001.02.3.4 999.1.2.3.4 10.0.0.99999999999999999999", "4111 1111 1111 1111, 4111-1111-1111-1112 4111111111111111 4111 1111 1111 1111 4111",
    "+49 30 1234567 +1((( +12 +123456789012345678 ++4930123456 +1 2", "9" * 5000 + " " + "7 " * 3000, "a" * 50_000 + "@", "z" * 50_000 + "@b.co", "1." * 3000, "4111 1111 1111 1111\n192.168.0.1\tme@x.yz\r\n+4930123456",
]


SPACE = " \t\n\x0b\x0c\r"
TOKEN = rf"[^{SPACE}0-9@_]*[0-9@_][^{SPACE}]*"


def words(text):
    return ["0" if re.search("[0-9@_]", w) else "".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in re.split(f"[{SPACE}]+", text) if w]


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def half(v):
    return hashlib.md5(low(v).encode()).hexdigest()[0] in pii.SEED_DIGITS


def instances(text):
    """(kind, start, end, value, seed, patterns) of base entities and of the other tokens with a sign of an identifier."""
    out = []
    for kind, form in [*FORMS.items(), ("id", TOKEN)]:
        found = list(re.finditer(form, text, re.ASCII))
        cuts = [0, *(x for m in found for x in m.span()), len(text)]
        pieces = [text[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True)]
        for i, m in enumerate(found):
            a, b, v, seed = *m.span(), m[0], True
            if kind == "id":
                a, b = a + len(v) - len(re.sub("^[^A-Za-z0-9]+", "", v)), b - len(v) + len(re.sub("[^A-Za-z0-9]+$", "", v))
                v = text[a:b]
                key = re.search("[A-Za-z0-9]{20,}", v)
                seed = bool(key) and sum(c.isdigit() for c in key[0]) >= 4 and sum(c.isalpha() for c in key[0]) >= 4 and half(v)
                if a >= b or any(x[1] < b and x[2] > a for x in out if x[0] != "id"):
                    continue
            elif not passes(kind, v):
                continue
            before, after = words(" 0 ".join(pieces[max(0, i - 2) : i + 1])), words(" 0 ".join(pieces[i + 1 : i + 4]))
            ctx = (["< " + " ".join(before[-2:])] if len(before) > 1 else []) + (["> " + " ".join(after[:2])] if len(after) > 1 else [])
            ctx += [f"= {before[-1]} {after[0]}"] if before and after else []
            out.append((kind, a, b, "".join(c.lower() if "A" <= c <= "Z" else c for c in v), seed, ctx))
    return out


def brute_ids(texts):
    """The places of identifiers that trusted patterns find, by text."""
    found, counter = [instances(t or "") for t in texts], {}
    edges = {}
    for rows in found:
        for _, _, _, v, seed, ctx in rows:
            for c in ctx:
                edges[c, v] = max(edges.get((c, v), 0.0), float(seed))
    for t in texts:
        w = words(t or "")
        for i, x in enumerate(w):
            if x != "0":
                for c in ([f"< {w[i - 2]} {w[i - 1]}"] if i > 1 else []) + ([f"> {w[i + 1]} {w[i + 2]}"] if i + 2 < len(w) else []) + ([f"= {w[i - 1]} {w[i + 1]}"] if 0 < i < len(w) - 1 else []):
                    counter.setdefault(c, set()).add(x)
    of = {}
    for (c, v), seed in edges.items():
        of.setdefault(c, []).append((v, seed))
    of = {c: x for c, x in of.items() if len(x) >= pii.MIN_SEEDS}
    plain = {c: sum(not seed and bool(re.search("^[^a-z@_]+$", v)) and len(re.sub("[^0-9]", "", v)) < 7 for v, seed in x) for c, x in of.items()}
    good, found_now = set(), set()
    while True:
        support = {c: sum(max(seed, pii.FOUND * (v in found_now)) for v, seed in x) for c, x in of.items()}
        now = {c for c in of if support[c] >= pii.MIN_SEEDS and support[c] / (support[c] + len(counter.get(c, ())) + plain[c] + 1) >= pii.CONFIDENCE}
        if now == good:
            break
        good, found_now = now, {v for c in now for v, seed in of[c] if not seed}
    return [sorted({(a, b) for kind, a, b, _, _, ctx in rows if kind == "id" and good & set(ctx)}) for rows in found]


def check(spark, texts):
    docs = spark.createDataFrame([(i, t, "base", 3) for i, t in enumerate(texts)], "doc_id long, text string, base string, tokens int").repartition(3)
    got = {r.doc_id: r for r in pii.find_pii(docs).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        counts, joined = brute(t)
        r = got[i]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == counts, t[:200]
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert ",".join(x for x in r.spans.split(",") if x[:3] != "id:") == joined
    for i, want in enumerate(brute_ids(texts)):
        r = got[i]
        assert [tuple(map(int, x.split(":")[1:])) for x in r.spans.split(",") if x[:3] == "id:"] == want, texts[i][:200]
        assert r.n_id == len(want) and r.n_spans == len(want) + sum(brute(texts[i])[0])
    return got


def test_base_spans_on_odd_texts(spark):
    check(spark, ODD)


def test_the_tables(spark, sf_dir):
    """All spans on the tables; every planted key (a token of 40 hexadecimal digits that is assigned) is found."""
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    got = check(spark, texts)
    planted = [(i, m.span(1)) for i, t in enumerate(texts) for m in re.finditer(r'token = "([0-9a-f]{40})"', t or "")]
    found = [f"id:{a}:{b}" in got[i].spans.split(",") for i, (a, b) in planted]
    assert len(found) < 2 * pii.MIN_SEEDS or sum(found) / len(found) >= 0.9


def test_withheld_keys_are_found_by_their_context_alone(spark):
    """Half of the keys are seeds; the others, and identifiers that have no key's form at all, stand in the same place."""
    keys = [hashlib.sha1(str(i).encode()).hexdigest() for i in range(40)]
    short = ["ZX-12-Q", "u_4411", "AB9", "k7-k8"]
    texts = [f'set the token = "{k}" and go' for k in keys + short] + [f"in {1900 + i} the shop had {i} seats" for i in range(60)] + ["a loose " + keys[0][:19] + " here"]
    got = check(spark, texts)
    hit = {i for i in got if got[i].n_id}
    assert hit == set(range(44))
    assert 10 <= sum(half(k) for k in keys) <= 30  # so 10 or more of them were not seeds


def test_plain_numbers_in_a_context_count_against_it(spark):
    seeds = [f"see page 10.0.0.{i} now" for i in range(4)]
    assert check(spark, [*seeds, "see page X-99 now"])[4].n_id == 1
    assert check(spark, [*seeds, "see page X-99 now", *(f"see page {i} now" for i in range(10, 20))])[4].n_id == 0


def test_contexts_that_seeds_induce_find_unseen_identifiers(spark):
    texts = [f"Please note customer number: 192.168.0.{i} today" for i in range(6)] + ["And customer number: AB-99812-X is new", "in the year 1999123 nothing", "customer number: 77"]
    got = check(spark, texts)
    at = texts[6].index("AB-99812-X")
    assert got[6].spans == f"id:{at}:{at + 10}" and got[6].n_id == 1
    assert got[7].spans == "" and got[8].spans == "id:17:19"


def test_ordinary_words_in_a_context_count_against_it(spark):
    seeds = [f"reach us at 10.0.0.{i} now" for i in range(4)]
    new = ["reach us at X-99 now"]
    assert check(spark, seeds + new)[4].n_id == 1
    words = [f"reach us at {w} now" for w in ("home", "work", "noon", "once", "night")]
    assert check(spark, seeds + new + words)[4].n_id == 0


def test_patterns_that_a_part_of_the_texts_settles(spark):
    """A common pair of words is given up after one text in SOME; what is found elsewhere is the same."""
    texts = [f"see the of 10.0.{i // 250}.{i % 250} then my key K{i}K and" for i in range(60)] + [f"one the of {''.join(chr(97 + int(d)) for d in str(i))} more" for i in range(400)] + [f"so my key 10.1.0.{i} it" for i in range(150)]
    got = check(spark, texts)
    assert sum(r.n_id for r in got.values()) == 60


def test_what_patterns_find_earns_trust_for_other_patterns(spark):
    """Seeds make "< my key" trusted; the tokens it finds stand after "< old pin" as well, which finds one more."""
    texts = [f"then my key 10.0.0.{i} it" for i in range(20)] + [f"so my key K-{i} ok" for i in range(6)] + [f"an old pin K-{i} yes" for i in range(6)] + ["the old pin Z-1 no"]
    got = check(spark, texts)
    assert got[len(texts) - 1].n_id == 1


def test_a_text_of_many_tokens_takes_seconds(spark):
    docs = spark.createDataFrame([(1, " ".join(f"{i} a@b{i}.cd" if i % 9 == 0 else str(i) for i in range(40_000)))], "doc_id long, text string")
    began = time.time()
    r = pii.find_pii(docs).first()
    assert r.n_email == 4445 and time.time() - began < 60


def test_repeats_nulls_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a@b.cd"), (1, "a@b.cd"), (None, "a@b.cd"), (None, None)], "doc_id long, text string")
    assert sorted((r.doc_id or -1, r.spans) for r in pii.find_pii(docs).collect()) == [(-1, ""), (-1, "email:0:6"), (1, "email:0:6"), (1, "email:0:6")]
    assert pii.find_pii(docs.limit(0)).count() == 0


def test_base_entities_of_each_kind_are_seeds(spark):
    """Seeds with spaces or without digits, within two words of others, glued to a mark, after long words."""
    long = "wordwithmanyletters" * 5
    planted = {
        "call desk": [f"+1 (743) 555-38{i}4" for i in range(10, 15)],
        "pay from": ["4111 1111 1111 1111", "5500 0000 0000 0004", "3400 0000 0000 009", "6011 0000 0000 0004", "4012 8888 8888 1881"],
        "write to": [f"{n}@example.com" for n in ("alice", "bob", "carol", "dan", "erin")],
        f"{long} host": [f"10.0.0.{i}" for i in range(1, 6)],
        "123456 ref": [f"10.1.0.{i}" for i in range(1, 6)],
    }
    texts = [f"Please {c} {v}, thanks" for c, vs in planted.items() for v in vs] + ["Please " + " and ".join(f"{c} AB-998{i}-X" for i, c in enumerate(planted)) + " or so AB-9987-X"]
    got = check(spark, texts)
    last = texts[-1]
    want = [last.index(f"AB-998{i}-X") for i in range(len(planted))]
    assert {f"id:{a}:{a + 9}" for a in want} <= set(got[len(texts) - 1].spans.split(","))
