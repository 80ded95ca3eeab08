"""Tilings, personal data, toxicity, quality and the mix against brute force or held-out labels."""

import hashlib
import itertools
import math
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from armspan.llm import contextual_pii, pu_quality, queries, toxic_crf
from armspan.llm.contextual_pii import base_spans, find_personal_data
from armspan.llm.source_schedule import mix, mixed_rows, mixed_sizes
from armspan.llm.string_tiling import leaks, without_leaks


def test_tiles_catch_reordered_passages(spark, odd_docs, no_docs):
    item = "one two three four five six seven eight nine ten eleven twelve"
    bench = spark.createDataFrame([(1, item), (2, "short item"), (3, ""), (4, None)], "item_id bigint, text string")
    swapped = "x seven eight nine ten eleven twelve y one two three four five six z"
    rows = [(1, swapped), (2, "one two three four five"), (3, "A SHORT item."), (4, None), (None, item.upper())]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = {(r.doc_id, r.item_id, r.tiles) for r in leaks(docs, bench).collect()}
    assert found == {(1, 1, "1:6:6,8:0:6"), (3, 2, "1:0:2"), (None, 1, "0:0:12")}
    assert sorted(r.doc_id for r in without_leaks(docs, bench).collect()) == [2, 4]
    assert leaks(no_docs, bench).count() == 0 and leaks(odd_docs, bench.limit(0)).count() == 0


def slow_tiles(doc, item, n):
    """Longest unmarked common runs first; ties by the place in the item, then in the document."""
    in_doc, in_item, tiles = [False] * len(doc), [False] * len(item), []
    while True:
        best = (n - 1, 0, 0)
        for j in range(len(item)):
            for i in range(len(doc)):
                k = 0
                while i + k < len(doc) and j + k < len(item) and doc[i + k] == item[j + k] and not (in_doc[i + k] or in_item[j + k]):
                    k += 1
                best = max(best, (k, -j, -i))
        if best[0] < n:
            return sorted(tiles)
        k, j, i = best[0], -best[1], -best[2]
        in_doc[i : i + k] = in_item[j : j + k] = [True] * k
        tiles.append((i, j, k))


def test_tiles_against_all_matches(spark):
    rng = random.Random(2)
    words = "ab bc cd de ef".split()
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 18)))) for i in range(12)]
    docs = []
    for i in range(60):
        item = items[i % 12][1].split()
        cut = rng.randint(0, len(item))
        docs.append((i, " ".join([rng.choice(words), *item[cut:], rng.choice(words), *item[:cut]] if i % 3 else [rng.choice(words) for _ in range(25)])))
    wanted = set()
    for doc_id, text in docs:
        for item_id, item in items:
            size = len(item.split())
            tiles = slow_tiles(text.split(), item.split(), min(5, size))
            if sum(k for _, _, k in tiles) >= 0.8 * size:
                wanted.add((doc_id, item_id, size, ",".join(f"{i}:{j}:{k}" for i, j, k in tiles)))
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    found = leaks(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3), bench)
    assert {(r.doc_id, r.item_id, r.item_words, r.tiles) for r in found.collect()} == wanted and len(wanted) > 20


def by_regex(text):
    """The fixed forms as their definitions read."""
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()][::-1]
        if 14 <= len(d) <= 19 and (sum(d[::2]) + sum(x * 2 - 9 * (x > 4) for x in d[1::2])) % 10 == 0:
            found.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
            found.append((m.start(), 3, m.end()))
    return sorted(found)


def test_fixed_forms():
    rng = np.random.default_rng(2)
    alphabet = list("a1.@-+ 0259()_é%")
    texts = ["".join(rng.choice(alphabet, 60)) for _ in range(4000)]
    texts += ["a@b.c@d.e", "x@@y.z", "1.2.3.4.5.6.7.8", "0001.2.3.4", "4111 1111 1111 1111", "+1 (017) 555-7713", ""]
    assert all(base_spans(text) == by_regex(text) for text in texts)


def test_contexts_find_unseen_identifiers(spark, odd_docs, no_docs):
    rows = [(i, f"hello there, write me at user{i}@mail.example.com soon") for i in range(8)]
    rows += [(8, "please write me at handle-2291 today"), (9, "meet me at noon"), (None, None)]
    found = {r.doc_id: r for r in find_personal_data(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert found[8].spans == "context:19:30" and found[8].n_email == 0
    assert found[0].spans.startswith("email:") and found[9].spans == found[None].spans == ""
    assert find_personal_data(odd_docs).count() == 9 and find_personal_data(no_docs).count() == 0


def contexts_found(spark, lead, seeds, others):
    """How many of the texts with a handle after ``lead`` have it as a context span."""
    rows = [(i, f"hello there, {lead} {seed} soon") for i, seed in enumerate(seeds)] + others
    rows += [(i, f"so {lead} handle-{i} today") for i in range(90_000, 90_005)]
    found = find_personal_data(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    return sum("context:" in r.spans for r in found if r.doc_id >= 90_000)


@pytest.mark.parametrize("form", ["{}anna@mail.org", "+1 555 0{}-44 21", "4111 1111 1111 {}"])
def test_seeds_of_any_form_count_for_their_pattern(spark, form):
    """E-mails without a digit, spaced phones and spaced cards."""
    parts = ["".join(chr(97 + int(c)) for c in str(i)) if "@" in form else str(i) for i in range(100, 2400)]
    texts = [form.format(part) for part in parts]
    seeds = [text for text in texts if base_spans(text) and base_spans(text)[0][::2] == (0, len(text))][:30]
    assert len(seeds) == 30
    assert contexts_found(spark, "please contact me at", seeds, []) == 5


def test_copies_of_a_plain_text_count_once(spark):
    seeds = [f"user{i}@mail.example.com" for i in range(20)]
    copies = [(1000 + i, "please contact me at noon") for i in range(300)]
    assert contexts_found(spark, "please contact me at", seeds, copies) == 5
    words = [(1000 + i, f"please contact me at {chr(97 + i // 26)}{chr(97 + i % 26)}") for i in range(300)]
    assert contexts_found(spark, "please contact me at", seeds, words) == 0


def sentences(n):
    """Random texts as lists of tokens: words, seeds, handles, and labels that mostly stand before those."""
    rng = random.Random(4)
    texts = []
    for i in range(n):
        tokens = []
        for k in range(rng.randint(3, 25)):
            draw = rng.random()
            if draw < 0.6:
                tokens.append(rng.choice(["call", "me", "at", "the", "of", "Write", "to", "and", "soon", "x"]) + str(rng.choice("abcdef")) * rng.randint(0, 2))
            elif draw < 0.8:
                tokens += [rng.choice(["mail:", "Account", "ref=", "from", "reach"]), rng.choice([f"user{i}@mail.org"] * 3 + [f"10.0.{i % 250}.{k}"] * 3 + [f"Code-{i}-{k}", "nobody"])]
            elif draw < 0.9:
                tokens += [f"id{i}x{k}@site.org", rng.choice(["answers", "is", "soon"])]
            else:
                tokens += [f"key-{i}{k}", rng.choice(["answers", "is", "soon"])]
        texts.append(tokens)
    return texts + texts[:5]


def brute_contexts(texts, c=0.7, rounds=3):
    """Spans of every text by the definition, with all plain words of all patterns listed."""
    slots, edges, plain = [], defaultdict(dict), defaultdict(set)
    bare = lambda t: t.rstrip(":=").lower()
    norm = lambda t: ("#" if any(x.isdigit() for x in t) else bare(t)) + (":" if t[-1] in ":=" else "")
    for number, tokens in enumerate(texts):
        text = "".join(t if t[-1] == "=" else t + " " for t in tokens)
        at = 0
        for k, token in enumerate(tokens):
            start = text.index(token, at)
            at = start + len(token)
            left, right = [norm(t) for t in tokens[max(0, k - 3) : k]], [norm(t) for t in tokens[k + 1 : k + 2]]
            patterns = [(tuple(left[-m:]), ()) for m in (1, 2, 3) if len(left) >= m]
            patterns += [((), tuple(right))] * len(right) + [(tuple(left[-1:]), tuple(right))] * (bool(left) and bool(right))
            if "@" in token or token.startswith("10.0."):
                seed = 1
            elif any(x.isdigit() for x in token):
                seed = 0
            else:
                for p in patterns:
                    plain[p].add(bare(token))
                continue
            slots.append((number, start, at, seed, token.lower(), patterns))
            for p in patterns:
                edges[p][token.lower()] = max(seed, edges[p].get(token.lower(), 0))
    score = {i: float(s) for found in edges.values() for i, s in found.items()}
    score = {i: max(float(found.get(i, 0)) for found in edges.values()) for i in score}
    seeds = {i for i in score if score[i]}
    for step in range(rounds):
        share = {}
        for p, found in edges.items():
            if sum(score[i] >= (c if step else 1.0) for i in found) >= 3:
                share[p] = sum(score[i] for i in found) / (len(found) + len(plain[p]) + 1)
        share = {p: s for p, s in share.items() if s >= c}
        for i in score:
            if i not in seeds:
                missed = 1.0
                for p in share:
                    if i in edges[p]:
                        missed *= 1 - share[p]
                score[i] = 1 - missed
    spans = defaultdict(list)
    for number, start, end, seed, _, patterns in slots:
        if seed or any(p in share for p in patterns):
            spans[number].append((start, end, seed))
    whole = ["".join(t if t[-1] == "=" else t + " " for t in tokens) for tokens in texts]
    return whole, [spans[n] for n in range(len(texts))]


def test_contexts_equal_the_unbounded_form(spark, monkeypatch):
    """In any portions and blocks, patterns and spans are those of all plain words listed."""
    texts, wanted = brute_contexts(sentences(150))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    assert sum(not seed for spans in wanted for _, _, seed in spans) > 30
    for looked, block in ((2_000, 100_000), (7, 3)):
        monkeypatch.setattr(contextual_pii, "_LOOKED", looked)
        monkeypatch.setattr(contextual_pii, "_BLOCK", block)
        found = {r.doc_id: r.spans for r in find_personal_data(docs).collect()}
        for number, spans in enumerate(wanted):
            parts = [s.split(":") for s in found[number].split(",") if s]
            assert [(int(a), int(b), int(kind != "context")) for kind, a, b in parts] == spans, texts[number]


def test_seeds_in_changing_wording(spark):
    """Labels, words behind and single words are patterns too: recall over handles that no form knows."""
    rng = random.Random(1)
    some = lambda: " ".join(rng.choice("lorem ipsum dolor sit amet quis velit nulla".split()) + rng.choice("abcdef") for _ in range(rng.randint(2, 6)))
    forms = ["{} e-mail: {} {}", "{} (account={}) {}", "{} username {} {}", "{} {} wrote: {}"]
    rows = [(i, rng.choice(forms).format(some(), f"user{i}@mail.org", some())) for i in range(200)]
    rows += [(1000 + i, rng.choice(forms).format(some(), f"handle-{i}99", some())) for i in range(40)]
    rows += [(2000 + i, f"{some()} 100{i} {some()}") for i in range(100)]
    found = {r.doc_id: r.spans for r in find_personal_data(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert sum("context:" in found[1000 + i] for i in range(40)) >= 36
    assert not any("context:" in found[2000 + i] for i in range(100))


def test_identifiers_and_contexts():
    text = 'x "AB-123456": id=9XYZ12, mail:anna@x.org (' + "y1" * 40 + ") " + "z" * 300_000 + "1 11:22 a12345"
    base = base_spans(text)
    assert [bare for _, _, bare in contextual_pii._identifiers(text, base)] == ["ab-123456", "9xyz12", "a12345"]
    start = text.index("anna")
    assert contextual_pii._around(text, start, start + 10) == ("id:", "#", "mail:", "")
    assert contextual_pii._around("tell Bob: the 2 (a@b.c) now!", 17, 22) == ("bob:", "the", "#", "now")
    assert contextual_pii._around("éa@b.c x", 1, 6) == ("", "", "", "x")


def test_query_against_definitions(spark, sf_dir):
    texts = {r.doc_id: r.text for r in queries.documents(spark, sf_dir).select("doc_id", "text").collect()}
    names = ["email", "ip", "card", "phone"]
    for r in queries.op5_contextual_pii(spark, sf_dir).collect():
        spans = by_regex(texts[r.doc_id] or "")
        base = ",".join(f"{names[kind]}:{a}:{b}" for a, kind, b in spans)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(kind == k for _, kind, _ in spans) for k in range(4)]
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        kept = [s for s in r.spans.split(",") if s and not s.startswith("context:")]
        assert ",".join(kept) == base


@pytest.mark.parametrize(("name", "label", "least"), [("op6_toxic_crf", "toxic", 0.95), ("op8_pu_quality", "quality", 0.9)])
def test_held_out_accuracy(spark, name, label, least):
    # The larger tables: a few dozen toxic examples are too few for stems that only some languages have.
    sf_dir = "/root/testdata/sf0.1"
    truth = {r.doc_id: r[label] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    held = [r for r in queries.QUERIES[name](spark, sf_dir).collect() if r.held_out and r.doc_id in truth]
    assert len(held) > 50 and sum(r.predicted == truth[r.doc_id] for r in held) >= least * len(held)


def test_mix_meets_targets(spark, sf_dir, odd_docs, no_docs):
    rows = queries.op7_source_schedule(spark, sf_dir).collect()
    source = {r.doc_id: r.source for r in queries.documents(spark, sf_dir).collect()}
    taken, target = defaultdict(int), {}
    for r in rows:
        assert r.taken <= 2 * r.size
        taken[source[r.doc_id]] += r.taken
        target[source[r.doc_id]] = r.target
    assert all(0 <= target[s] - taken[s] < 1 for s in target)
    assert all((r.slot is None) == (r.taken == 0) for r in rows)
    assert abs(sum(target.values()) - 1.5 * sum(r.size for r in rows)) < 1
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, queries.op7_source_schedule(spark, sf_dir).collect()), key=str)
    assert mixed_sizes(odd_docs).count() == 9 and mixed_sizes(no_docs).count() == 0


def schedule(blocks):
    """Source of every slot: golden-ratio points in the cumulative block counts."""
    n = sum(blocks)
    step = max(1, round(n * (math.sqrt(5) - 1) / 2))
    while math.gcd(step, n) > 1:
        step += 1
    ends = list(itertools.accumulate(blocks))
    return [next(s for s, end in enumerate(ends) if i * step % n < end) for i in range(n)]


def test_slots_follow_the_schedule(spark):
    sizes = {"a": 60, "b": 10, "c": 25, None: 5}
    rows = [(i, " ".join(["w"] * (7 + i % 5)), s) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    docs = spark.createDataFrame(rows + [(900, None, "a"), (901, "", None)], "doc_id bigint, text string, source string")
    pieces, whole = mix(docs, block=16)
    target = {r.source: r.target for r in whole.collect()}
    names = ["a", "b", "c", None]
    wanted = schedule([math.ceil(math.floor(target[s]) / 16) for s in names])
    found = {p.slot: names.index(p.source) for p in pieces.collect()}
    assert [found[i] for i in range(len(wanted))] == wanted and len(found) == len(wanted)
    first = {}
    for p in pieces.collect():
        first.setdefault((p.t, p.epoch), []).append((p.slot, p.words))
    place = {r.t: r.row.c0 for r in whole.collect()}
    size = {i: len((text or "").split()) for i, text, _ in rows}
    plan = []
    for t in {t for t, _ in first}:
        epochs = sorted((min(found)[0], sum(n for _, n in found)) for (u, _), found in first.items() if u == t)
        most = [e for e in epochs if 2 * e[1] > size[place[t]]] or epochs[:1]
        plan += [(slot, place[t]) for slot, _ in most]
    plan.sort()
    out = [r.doc_id for r in mixed_rows(docs, block=16).collect()]
    assert sorted(out[-2:]) == [900, 901]
    slots = dict.fromkeys(i for _, i in plan)
    assert sorted(out[:-2]) == sorted(i for _, i in plan) and len(slots) > 50
    by_slot = defaultdict(set)
    for slot, i in plan:
        by_slot[slot].add(i)
    at = 0
    for slot in sorted(by_slot):
        n = sum(s == slot for s, _ in plan)
        assert set(out[at : at + n]) == by_slot[slot]
        at += n


@pytest.mark.parametrize("model", [pu_quality, toxic_crf])
def test_samples_are_bounded(spark, model, monkeypatch):
    """A text that a third of the rows have, and rows that repeat, do not outgrow the sample."""
    texts = [f"good words number {i} and more of them" if i % 2 else f"bad b{i} words! {'damn' if i % 4 else ''}" for i in range(400)]
    rows = list(enumerate(texts)) + [(1000 + i, "the same text again and again") for i in range(300)] + [(1, texts[1])] * 200
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    labels = spark.createDataFrame([(i, i % 2, int(i % 4 == 2)) for i in range(400)], "doc_id bigint, quality int, toxic int")
    sizes = []

    def counted(df, label, stored=model.stored):
        out = stored(df, label)
        if label.endswith("sample"):
            sizes.append(out)
        return out

    monkeypatch.setattr(model, "stored", counted)
    model.fit(docs, labels, F.lit(True), rows=40)
    assert len(sizes) == 1
    if model is toxic_crf:
        assert sizes[0].count() <= 2 * 40 and sizes[0].groupBy("y", "h").count().where("count > 1").isEmpty()
    else:
        # The drawn rows of the frequent text come by their share, not all or none.
        assert sizes[0].where("p = 0 and u = 1").count() < 150


def test_odd_documents_are_scored_and_kept(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(i, i % 2, i % 2, "x") for i in range(1, 9)], "doc_id bigint, quality int, toxic int, y string")
    everyone = F.lit(True)
    for fit, score, name in ((toxic_crf.fit, toxic_crf.toxicity, "toxic"), (pu_quality.fit, pu_quality.quality, "quality")):
        for docs, found in ((odd_docs, labels), (odd_docs, labels.limit(0)), (no_docs, labels)):
            model = fit(docs, found, everyone)
            assert all(0 <= r.score <= 1 for r in score(odd_docs, model).collect())
            assert score(odd_docs, model).count() == 9 and score(no_docs, model).count() == 0, name
    assert toxic_crf.without_toxic(no_docs, labels).count() == 0
    kept = toxic_crf.without_toxic(odd_docs, labels)
    assert kept.columns == odd_docs.columns and kept.count() <= 9
    bench = spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog"), (None, None)], "item_id bigint, text string")
    clean = without_leaks(odd_docs, bench)
    assert clean.columns == odd_docs.columns and sorted(r.doc_id or 0 for r in clean.collect()) == [0, 2, 3, 5, 6, 7, 8]
    mixed = mixed_rows(odd_docs)
    assert mixed.columns == odd_docs.columns and mixed_rows(no_docs).count() == 0
    assert {2, 3, 5} <= {r.doc_id for r in mixed.collect()}
