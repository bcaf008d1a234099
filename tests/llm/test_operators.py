import collections
import hashlib
import itertools
import math
import random
import re
import sys

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from compare import connection, differences, rows as cells
from pyspark.sql import functions as F

from tarnlake.llm import components, exact_dedup, fingerprints, html_text, langid, mixing, pieces, queries, quotations, sharding, simhash, toxicity
from tarnlake.llm.components import connected_components

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_agree_with_their_sql(spark, name):
    df = queries.QUERIES[name](spark, SF)
    if name == "op3_exact_dedup":
        df = df.drop("row")
    assert differences(df, queries.ORACLES[name], SF) == []


# -- op1 ----------------------------------------------------------------------------------------------------------


def test_mixing_awkward(awkward, nothing):
    got = mixing.mix(awkward.drop("kept"), {"a": 100.0}, other=1.0, epochs=30.0, seed=3)
    assert got.columns == [*awkward.drop("kept").columns, "copy", "shuffle_key"]
    n = collections.Counter(r.doc_id for r in got.collect())
    assert n[7] % 2 == 0 and n[1] > 20  # rows of one id share a draw; a large mean is drawn in parts
    assert mixing.mix(nothing, {"a": 1.0}).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(awkward.withColumnRenamed("row", "copy"), {})
    with pytest.raises(ValueError):
        mixing.mix(awkward, {"a": -1.0})


def test_mixing_follows_a_poisson_law(spark):
    df = spark.range(40000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 4 == 0, "x").otherwise("y").alias("source"))
    got = mixing.mix(df, {"x": 3.0, "y": 1.0}, epochs=1.0).groupBy("doc_id", "source").count().groupBy("source", "count").count().toDF("source", "k", "n").collect()
    n = {(r.source, r.k): r.n for r in got}
    for source, mean, size in (("x", 3.0, 10000), ("y", 1 / 3, 30000)):
        for k in range(1, 5):
            p = math.exp(-mean) * mean**k / math.factorial(k)
            assert abs(n.get((source, k), 0) - size * p) < 5 * math.sqrt(size * p) + 5


# -- op2 ----------------------------------------------------------------------------------------------------------

MESSAGES = [
    (1, 0, "user", "Hello there\nline two\n\nSecond para"),
    (1, 1, "assistant", "On Monday X wrote:\n> Hello there\n> line two\n\nMy answer"),
    (1, 2, "user", "> > Hello there line two\n> my  ANSWER\nok then"),
    (1, 3, "user", "> line two\nre line"),
    (1, 4, "user", "> ok then\n> re line\nfoo"),
    (1, 5, "assistant", None),
    (2, 0, "user", "> Hello there\nother"),
    (1, 3000, "user", ">ok then\nlate"),
    (None, 1, "user", "> x"),
    (2, None, "user", "> other\nz"),
    (1, 0, "user", "Hello there\nline two"),
    (3, 0, "system", ""),
]


def test_quotations(spark, tmp_path):
    df = spark.createDataFrame([(*m, "q") for m in MESSAGES], "conv_id bigint, turn bigint, role string, text string, hash string").coalesce(1)
    got = quotations.link_quotations(df)
    by = {(r.conv_id, r.turn, r.role, r.text): (r.reply_to, r.thread, r.depth) for r in got.collect()}
    assert by[1, 1, "assistant", "My answer"] == (0, 0, 1)
    assert by[1, 2, "user", "ok then"] == (1, 0, 2)  # the outermost quote, not what it quotes
    assert by[1, 3000, "user", "late"] == (2, 0, 3)  # found in an earlier slice of turns
    assert by[2, 0, "user", "other"] == (None, 0, 0)  # another conversation's message is no source
    df.drop("hash").write.parquet(str(tmp_path / "conversations.parquet"))
    assert differences(got, quotations.ORACLE, str(tmp_path)) == []
    assert quotations.link_quotations(df.where("false")).count() == 0


# -- op3 ----------------------------------------------------------------------------------------------------------


def test_cuckoo_index_inserts_deletes_and_grows():
    index, truth, rng = exact_dedup.CuckooIndex(1), {}, random.Random(1)
    keys = [hashlib.sha256(bytes([i % 256, i // 256])).digest() for i in range(4000)]
    for step in range(20000):
        k = rng.choice(keys)
        if rng.random() < 0.6:
            assert index.put(k, step) == (k not in truth)
            truth[k] = step
        else:
            assert index.delete(k) == (truth.pop(k, None) is not None)
    assert len(index) == len(truth) and dict(index.items()) == truth
    assert all((k in index) == (k in truth) and index.get(k) == truth.get(k) for k in keys)


def test_an_index_handed_on_in_parts_folds_to_the_same_groups():
    rows = [(hashlib.sha256(str(i % 37).encode()).digest(), i, i) for i in range(500)]
    batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[i : i + 7])], ["digest", "id", "row"]) for i in range(0, 500, 7)]
    parts = list(exact_dedup._fold(iter(batches), 5))
    assert sum(b.num_rows for b in parts) > 37
    whole = lambda found: sorted(r for b in found for r in zip(*b.to_pydict().values()))
    assert whole(exact_dedup._fold(iter(parts))) == whole(exact_dedup._fold(iter(batches)))


def test_exact_dedup_awkward(awkward, nothing):
    got = exact_dedup.exact_dedup(awkward).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    assert by[1][0].keep_id == by[2][0].keep_id == 10 and by[1][0].group_size == 3 and not by[1][0].kept
    assert by[3][0].keep_id == 4 and by[4][0].kept  # null and '' are one group
    assert sorted(r.kept for r in by[7]) == [False, True]
    assert by[None][0].kept and by[None][0].keep_id is None
    assert sum(r.kept for r in got) == len({r.text_sha256 for r in got})
    assert by[7][0].text_sha256 == hashlib.sha256(b"short").hexdigest()
    assert exact_dedup.exact_dedup(nothing).count() == 0
    kept = exact_dedup.drop_copies(awkward)
    assert kept.columns == awkward.columns and kept.count() == sum(r.kept for r in got)
    assert exact_dedup.drop_copies(nothing).count() == 0


# -- op4 ----------------------------------------------------------------------------------------------------------


def test_best_fit_decreasing_is_best_fit_decreasing():
    rng = random.Random(2)
    for _ in range(40):
        sizes = [(f"g{i}", rng.randint(1, 60)) for i in range(rng.randint(0, 80))]
        got, loads = sharding.best_fit_decreasing(sizes, 100)
        bins, where = [], {}
        for name, size in sorted(sizes, key=lambda x: (-x[1], x[0])):
            fits = [(100 - load, b) for b, load in enumerate(bins) if load + size <= 100]
            if not fits:
                bins.append(0)
                fits = [(100, len(bins) - 1)]
            b = min(fits)[1]
            bins[b] += size
            where[name] = b
        assert got == where and loads == bins
    with pytest.raises(ValueError):
        sharding.best_fit_decreasing([("a", 101)], 100)


def test_packing_classes_is_packing_every_item():
    rng = random.Random(12)
    for _ in range(60):
        sizes = [rng.choice((1, 2, 3, 7, 7, 30, rng.randint(1, 60))) for _ in range(rng.randint(0, 120))]
        where, loads = sharding.best_fit_decreasing([(f"{i:04d}", s) for i, s in enumerate(sizes)], 100)
        runs, got = sharding.pack_classes(list(collections.Counter(sizes).items()), 100)
        assert got == loads
        for size in set(sizes):
            bins = [where[f"{i:04d}"] for i, s in enumerate(sizes) if s == size]
            assert bins == [next(b for end, b in runs[size] if rank < end) for rank in range(len(bins))]
    assert sharding.pack_into([], 4) == {}


def test_every_group_is_packed_as_the_plain_algorithm_does(spark, monkeypatch):
    monkeypatch.setattr(sharding, "ROWS_A_SLICE", 300)
    got = sharding.shard(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), 16).collect()
    sizes, shards = collections.Counter(), {}
    for r in got:
        sizes[r.group_key] += r.size
        shards[r.group_key] = r.shard
    loads = collections.Counter()
    for key, size in sizes.items():
        loads[shards[key]] += size
    classes = collections.Counter(sizes.values())
    capacity = next(c for c in range(max(loads.values()), 2 * max(loads.values())) if len(sharding.pack_classes(list(classes.items()), c, 16)[1]) <= 16)
    where, plain = sharding.best_fit_decreasing(sizes.items(), capacity)
    assert where == shards and max(plain) - min(plain) <= 0.01 * capacity


def test_sharding(awkward, nothing, docs):
    for df in (awkward, docs):
        got = sharding.shard(df, 4).collect()
        assert len(got) == df.count()
        for s, part in itertools.groupby(sorted(got, key=lambda r: (r.shard, r.slot)), key=lambda r: r.shard):
            assert [r.slot for r in part] == list(range(len([r for r in got if r.shard == s])))
        places = collections.defaultdict(set)
        for r in got:
            places[r.group_key].add(r.shard)
        assert all(len(p) == 1 for p in places.values())
    sizes = collections.Counter()
    for r in got:
        sizes[r.shard] += r.size
    assert max(sizes.values()) - min(sizes.values()) <= 0.02 * sum(sizes.values()) / 4
    by = {r.doc_id: r for r in sharding.shard(awkward, 4).collect()}
    assert by[3].size == 1 and by[3].text_crc32 == 0 and by[6].size == len("é ñ ß 你好 😀".encode()) + 1
    assert sharding.shard(nothing).count() == 0


# -- op5 ----------------------------------------------------------------------------------------------------------


def segmentations(v, text):
    text = "▁" + text.replace(" ", "▁")

    def rest(i):
        if i == len(text):
            yield (), 0.0
        for n in range(1, min(16, len(text) - i) + 1):
            p = v.ids.get(text[i : i + n])
            if p is not None or n == 1:
                ids = (p,) if p is not None else tuple(v.byte_ids[list(text[i].encode())].tolist())
                for more, score in rest(i + n):
                    yield ids + more, score + (float(v.logs[p]) if p is not None else pieces.UNKNOWN)

    found = collections.defaultdict(list)
    for ids, score in rest(0):
        found[ids].append(score)
    total = np.logaddexp.reduce([s for ss in found.values() for s in ss])
    return {ids: float(np.exp(np.logaddexp.reduce(ss) - total)) for ids, ss in found.items()}


@pytest.mark.parametrize("text", ["the cat", "ab  c"])
def test_samples_without_replacement_follow_the_lattice(text):
    s, n = pieces.sampler(pieces.MODEL), 20000
    p = segmentations(s.vocabulary, text)
    got = s.sample([text] * n, [pieces.row_key(i, 1) for i in range(n)], 3)
    pairs = collections.Counter((tuple(x[0][0].tolist()), tuple(x[1][0].tolist())) for x in got)
    for (a, pa), (b, pb) in itertools.permutations(p.items(), 2):
        expected = n * pa * pb / (1 - pa)
        assert abs(pairs[a, b] - expected) < 5 * math.sqrt(expected) + 5
    for x in got[:300]:
        assert len({tuple(y[0].tolist()) for y in x}) == min(3, len(p))
        assert [y[2] for y in x] == sorted((y[2] for y in x), reverse=True)
        assert all(abs(math.log(p[tuple(y[0].tolist())]) - y[1]) < 1e-9 and y[3] <= 0 for y in x)
        assert all(s.decode(y[0]) == text for y in x)


def test_every_text_comes_back():
    own = pieces.sampler(pieces.MODEL)
    texts = ["a\U0010fffeb c", "x\u2581y  z\u2581 ", "  lead", "trail ", "\u2581", "\u2581\u2581 \u2581", " ", "  ", "é😀\U0010ffff", None, ""]
    for some in (texts, [*texts, "\0 a\0b  ", "\0"]):
        for text, found in zip(some, own.sample(some, list(range(len(some))), 3)):
            assert all(own.decode(x[0]) == (text or "") for x in found)


def test_texts_are_sampled_together_and_alone_alike():
    own, rng = pieces.sampler(pieces.MODEL), random.Random(3)
    texts = ["".join(rng.choices("abcde  é😀▁the", k=rng.choice([0, 1, 5, 40, 900]))) for _ in range(60)] + ["\u4e00" * 30, None, "the " * 700]
    for k in (1, 2, 5):
        for i, found in enumerate(own.sample(texts, list(range(len(texts))), k)):
            (alone,) = own.sample([texts[i]], [i], k)
            assert [(x[0].tolist(), *x[1:]) for x in found] == [(x[0].tolist(), *x[1:]) for x in alone]  # to the last bit


def test_more_texts_take_no_more_steps():
    own, rng = pieces.sampler(pieces.MODEL), random.Random(4)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) for _ in range(300)]

    def steps(n):
        texts, count = [" ".join(rng.choices(words, k=300)) for _ in range(n)], 0

        def called(frame, event, _):
            nonlocal count
            count += event == "call" and frame.f_code.co_filename == pieces.__file__

        sys.setprofile(called)
        try:
            own.sample(texts, list(range(n)), 2)
        finally:
            sys.setprofile(None)
        return count

    assert steps(400) - steps(40) < 5 * 360  # splitting into words is two calls a text


def test_pieces_awkward(awkward, nothing):
    got = pieces.decode_pieces(pieces.sample_pieces(awkward, 2)).collect()
    texts = awkward.select("doc_id", "text").collect()
    assert sorted({(str(r.doc_id), r.text) for r in got}) == sorted({(str(r.doc_id), r.text or "") for r in texts})
    by = collections.defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    assert [r.ids for r in by[3]] == [[]] and len(by[8]) == 2 and by[8][0].ids != by[8][1].ids
    assert len(by[7]) == 4 and len({tuple(r.ids) for r in by[7]}) == 2
    again = {(r.doc_id, r["sample"]): r.ids for r in pieces.sample_pieces(awkward.repartition(5), 2).collect()}
    assert all(again[r.doc_id, r["sample"]] == r.ids for r in got)  # partitions don't matter
    assert pieces.sample_pieces(nothing).count() == 0
    with pytest.raises(ValueError):
        pieces.sample_pieces(awkward, 0)


# -- op6 ----------------------------------------------------------------------------------------------------------


def test_grammar_marks_matches():
    m = toxicity.Model({"idiot": 1.0, "lowei*": 1.0}, np.zeros(4))
    weight = lambda text: sum(m.clauses(text))
    assert weight("you are an idiot") > weight("an idiot") > weight("he said an idiot") > 0
    assert weight("an idiot") > weight("not an idiot") > 0
    assert weight("I will kill you") == weight("you I will kill") > 0 and weight("I will kill. you") == 0  # an address anywhere in the clause
    assert weight("an idiot like you") == weight("you are an idiot")
    assert weight("kill time") == 0 and weight("idiotic") == 0 and weight("ein Loweischaft da") == 1.0
    assert len(m.clauses("idiot. you idiot! fine")) == 2
    assert m.clauses("") == []


def slow_marks(symbols):
    """What the grammar says, word by word."""
    out = []
    for i, c in enumerate(symbols):
        if c not in "IT":
            out.append(c)
            continue
        left = 0  # the reach of a negation, used up by words and ended by a match
        for x in symbols[:i]:
            left = 3 if x == "N" else 0 if x in "IT" else max(0, left - 1)
        marks = "@" if "Y" in symbols else ""
        marks += "-" if left else ""
        marks += '"' if "R" in symbols[:i] else ""
        out.append("O" if c == "T" and "@" not in marks else c + marks)
    return out


def test_the_composed_machine_is_its_parts_in_turn():
    rng, machine = random.Random(3), toxicity.grammar()
    parts = [toxicity.negation(), toxicity.reported(), toxicity.targeted()]
    for _ in range(3000):
        symbols = rng.choices([*toxicity.CLASSES, "I@", "T@"], k=rng.randint(0, 12))
        now = symbols
        for part in parts:
            state, out = part.start, []
            for x in now:
                state, wrote = part.step(state, x)
                out.append(wrote)
            now = out
        state, composed = machine.start, []
        for x in symbols:
            state, wrote = machine.step(state, x)
            composed.append(wrote)
        assert composed == now
        plain = [x[0] for x in symbols]
        assert [(x[0], set(x[1:])) for x in toxicity.marked(plain, machine)] == [(x[0], set(x[1:])) for x in slow_marks(plain)]


def test_scores_against_a_naive_scorer():
    """Every clause cut out and read whole, without the automaton."""
    rng = random.Random(9)
    model = toxicity.Model({"idiot": 1.5, "lowei*": 0.7}, np.array([-3.0, 2.0, 1.0, 0.5]))
    words = ["idiot", "Loweischaft", "lowei", "kill", "you", "not", "said", "plain", "word", "du", "idiots", "skill", "don't", "ok"]

    def symbol(w):
        for c, listed in (("R", toxicity.REPORTS), ("N", toxicity.NEGATIONS), ("Y", toxicity.TARGETS), ("T", toxicity.THREATS)):
            if w in listed:
                return c, 1.0
        return ("I", 1.5) if w == "idiot" else ("I", 0.7) if w.startswith("lowei") else ("O", 0.0)

    for _ in range(300):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", ", ", ". ", "! ", "\n"]) for _ in range(rng.randint(0, 40)))
        sums = []
        for clause in re.split(r"[.!?;:\n,]+", text.lower()):
            read = [symbol(w) for w in re.findall(r"[a-z']+", clause)]
            sums.append(sum(toxicity.weight_of(m) * v for m, (_, v) in zip(slow_marks([c for c, _ in read]), read)))
        sums = [x for x in sums if x > 0]
        z = float(model.coef @ np.array([1, math.log1p(sum(sums)), max(sums, default=0.0), math.log1p(len(sums))]))
        assert abs(model.score(text) - 1 / (1 + math.exp(-z))) < 1e-9


def test_a_clause_starts_at_the_punctuation_however_far_back():
    m = toxicity.Model({"idiot": 1.0}, np.zeros(4))
    far = "word " * 200
    assert m.clauses(f"he said so. {far}idiot") == [1.0]
    assert m.clauses(f"you were here. {far}kill") == [] and m.clauses(f"{far}you {far}idiot") == m.clauses(f"{far}idiot {far}you") == [1.25]
    assert m.clauses(f"idiot, he said so. {far}idiot") == [1.0, 1.0]


def test_toxicity_held_out(spark, awkward, nothing):
    """On planted rows, whose marks follow from their words; and on the labels of sf0.1, a few of which are noise."""
    rng = random.Random(40)
    plain = ["".join(rng.choices("abcdefghijklmnoprst", k=rng.randint(3, 9))) for _ in range(3000)]
    bad = ["grolmich", "vantusser", "idiot", "quelbrun"]
    rows = []
    for i in range(1800):
        words, toxic = rng.choices(plain, k=rng.randint(15, 120)), i % 3 == 0
        for _ in range(3 * toxic):
            words.insert(rng.randrange(len(words)), rng.choice(bad) + rng.choice(["", "", "en", "s"]))
        rows.append((i, " ".join(w + rng.choice(["", "", "", "", ",", "."]) for w in words), int(toxic)))
    planted = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    sf = "/root/testdata/sf0.1"
    for docs, labels, least in ((planted.drop("toxic"), planted.drop("text"), 0.95), (spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"), 0.8)):
        model = toxicity.fit(docs, langid.learnable(labels, mod=3, but=1))
        got = toxicity.score(docs, model).join(labels, "doc_id").where("held_out")
        r = got.agg(F.avg(F.when(F.col("toxic") == 1, F.col("predicted"))).alias("recall"), F.avg(F.when(F.col("toxic") == 0, F.col("predicted"))).alias("wrong")).first()
        assert r.recall > least and r.wrong < 0.02
    scored = toxicity.score(awkward, model).collect()
    assert len(scored) == awkward.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in scored)
    assert toxicity.score(nothing, model).count() == 0
    kept = toxicity.keep_clean(awkward, model)
    assert kept.columns == awkward.columns and kept.count() == awkward.count()
    assert toxicity.keep_clean(nothing, model).count() == 0
    assert toxicity.fit(nothing, labels.where("false")).forms == toxicity.default_model().forms


# -- op7 ----------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_masks_cover(radius):
    masks = simhash.covering_masks(radius)
    assert len(masks) == 2 ** (radius + 1) - 1
    for places in itertools.combinations(range(64), radius):
        assert any(not any(m >> p & 1 for p in places) for m in masks)


def slow_print(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split() if w]
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(prints):
    ids = [i for i, _ in prints]
    parent = list(range(len(ids)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(ids)), 2):
        if (prints[a][1] ^ prints[b][1]).bit_count() <= 2:
            parent[root(a)] = root(b)
    least = {}
    for k, i in enumerate(ids):
        if i is not None:
            least[root(k)] = min(least.get(root(k), i), i)
    return [least.get(root(k)) for k in range(len(ids))]


def test_simhash_against_brute_force(awkward, nothing, docs, spark):
    for df in (awkward, docs):
        rows = df.select("doc_id", "text").collect()
        prints = [(r.doc_id, slow_print(r.text)) for r in rows]
        want = sorted((str(i), f"{p:016x}", str(c)) for (i, p), c in zip(prints, brute_components(prints)))
        assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in simhash.near_groups(df).collect()) == want
    assert simhash.near_groups(nothing).count() == 0


def test_near_links_on_planted_prints(spark):
    rng = random.Random(4)
    prints = []
    for _ in range(60):
        base = rng.getrandbits(64)
        prints += [base] + [base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4))) for _ in range(6)]
    prints = sorted(set(prints))
    df = spark.createDataFrame([(simhash._signed(p),) for p in prints], "fp bigint")
    found = {r.node: r.root for r in connected_components(simhash.near_links(df, 2)).collect()}
    got = [found.get(simhash._signed(p), simhash._signed(p)) for p in prints]
    want = brute_components([(i, p) for i, p in enumerate(prints)])
    assert len(set(zip(got, want))) == len(set(got)) == len(set(want))


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 50)] + [(5000, 5001), (5001, 5000), (5000, 5000)]
    random.Random(5).shuffle(edges)
    df = spark.createDataFrame(edges + [(None, 3)], "a bigint, b bigint").repartition(7)
    got = {r.node: r.root for r in connected_components(df).collect()}
    assert got == {**{i: 0 for i in range(201)}, **{1000 + i: 1000 for i in range(50)}, 5000: 5000, 5001: 5000}
    assert connected_components(df.where("false")).count() == 0


def test_contraction_in_parts_keeps_the_components(monkeypatch):
    monkeypatch.setattr(components, "NODES", 10)
    edges = [(i, i + 2) for i in range(100)] + [(7, 300), (300, 301)]
    batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*edges[i : i + 5])], ["a", "b"]) for i in range(0, len(edges), 5)]
    links = [(a, b) for batch in components._contract_here(iter(batches)) for a, b in zip(*batch.to_pydict().values())]
    parts = lambda pairs: {frozenset(c) for c in merged_groups(pairs)}
    assert parts(links) == parts(edges)


def merged_groups(pairs):
    groups = []
    for pair in pairs:
        hit = [g for g in groups if g & set(pair)]
        groups = [g for g in groups if g not in hit] + [set(pair).union(*hit)]
    return groups


def set_links(sets, similarity):
    return [(a, b) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b])]


def merged(pairs):
    return {frozenset(g) for g in merged_groups(pairs)}


@pytest.mark.parametrize("within", [True, False])
def test_alike_chain_joins_what_all_pairs_join(within):
    rng = random.Random(21)
    for _ in range(60):
        bases = [set(rng.sample(range(60), rng.randint(1, 30))) for _ in range(3)]
        sets = {n: set(rng.choice(bases)) for n in range(25)}
        for s in sets.values():
            for _ in range(rng.randint(0, 6)):
                s.symmetric_difference_update({rng.randrange(80)})
        sets[25], sets[26] = set(), set()
        root, own = [n // 2 * 2 if n < 8 else n for n in range(27)], [n % 3 for n in range(27)]
        arrays = [np.array(sorted(sets[n]), np.uint32) for n in range(27)]
        got = list(simhash.alike_chain(arrays, np.array(root), np.array(own), within, 0.8))
        want = [(a, b) for a, b in set_links(sets, 0.8) if within or own[a] != own[b]]
        known = [(n, root[n]) for n in range(27)]
        assert merged([*known, *got]) == merged([*known, *want]) and {tuple(sorted(x)) for x in got} <= set(want)


@pytest.mark.parametrize("block", [2, 3, 4096])
def test_open_runs_are_settled_where_they_meet(spark, monkeypatch, block):
    """All links of a run are found that join components, in blocks too, those within the run's largest component left out."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = random.Random(13)
    sets = {n: set(rng.sample(range(40), rng.randint(20, 34))) for n in range(1, 31)} | {31: set(), 32: set()}
    rows = [(n, bytearray(np.array(sorted(s), "<u4").tobytes()), len(s)) for n, s in sets.items()]
    kept = spark.createDataFrame(rows, "node bigint, shingles binary, size bigint")
    met = spark.createDataFrame([(0, 5, n, 32) for n in sets] + [(1, 9, n, 3) for n in (1, 2, 3)], "tab int, key bigint, node bigint, n bigint")
    found = [(n, 3) for n in range(3, 15)]
    opened = simhash._open_runs(met, spark.createDataFrame(found, "node bigint, root bigint"), kept)
    got = [(r.a, r.b) for r in simhash._dealt(opened, kept).mapInArrow(simhash._settle_batches(0.7), "a bigint, b bigint").collect()]
    want = set_links(sets, 0.7)
    assert merged([*found, *got]) == merged([*found, *want]) and {tuple(sorted(x)) for x in got} <= set(want)


def test_large_buckets_are_dealt_anew(monkeypatch):
    rng = random.Random(14)
    prints = set()
    for _ in range(40):
        base = rng.getrandbits(20) << 11
        prints |= {base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))) for _ in range(12)}
    prints = np.array(sorted(prints), np.uint64)
    whole = simhash.chain_components(prints, 2)
    monkeypatch.setattr(simhash, "TOGETHER", 8)
    dealt = simhash.chain_components(prints, 2)
    known = [(int(p), int(p)) for p in prints]
    assert merged([*known, *whole]) == merged([*known, *dealt])


def test_drop_near_against_brute_force_on_shared_passages(spark):
    """Groups that share a long passage meet in the same tables; each pair at 0.8 must be settled, and no other row may go."""
    rng = random.Random(8)
    words = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(4000)]
    passage, rows = rng.choices(words, k=60), []
    for _ in range(30):
        base = passage + rng.choices(words, k=25)
        for copy in range(3):
            text = list(base)
            for _ in range(copy):
                text[rng.randrange(len(text))] = rng.choice(words)
            rows.append((len(rows), " ".join(text)))
    sets = [{" ".join(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for _, t in rows]
    pairs = [(a, b) for a, b in itertools.combinations(range(len(rows)), 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    groups = merged_groups([*pairs, *((i, i) for i in range(len(rows)))])
    kept = {r.doc_id for r in simhash.drop_near(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)).collect()}
    assert len(pairs) > 30 and all(len(g & kept) == 1 for g in groups)


def test_drop_near_keeps_one_of_each_group(spark, awkward, nothing):
    rng = random.Random(6)
    words = ["".join(rng.choices("abcdefghij", k=5)) for _ in range(3000)]
    rows, n = [], 0
    for g in range(40):
        base = rng.choices(words, k=rng.randint(80, 200))
        for copy in range(rng.randint(1, 4)):
            text = list(base)
            if copy:
                text[rng.randrange(len(text))] = "changed"
            rows.append((n, " ".join(text), g))
            n += 1
    df = spark.createDataFrame(rows, "doc_id bigint, text string, g int")
    kept = [r.g for r in simhash.drop_near(df).collect()]
    assert sorted(kept) == list(range(40))
    left = simhash.drop_near(exact_dedup.drop_copies(awkward))
    assert left.columns == awkward.columns and left.where("doc_id = 6").count() == 1
    assert simhash.drop_near(nothing).count() == 0


def test_drop_near_against_brute_force_on_short_texts(spark):
    """Texts of 5 to 40 words have 1 to 36 shingles: an estimate must not put their pairs aside, nor a table miss them."""
    rng = random.Random(12)
    words = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(4000)]
    rows = []
    for g in range(400):
        base = rng.choices(words, k=5 + g % 36)
        rows.append((len(rows), " ".join(base)))
        for extra in {0, 1, (len(base) - 4) // 4}:  # n shingles of n + extra are at 0.8 or more up to a quarter of n
            rows.append((len(rows), "  ".join(base + rng.choices(words, k=extra))))
    sets = [{" ".join(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for _, t in rows]
    by = collections.defaultdict(set)
    for i, s in enumerate(sets):
        for x in s:
            by[x].add(i)
    met = {(a, b) for group in by.values() for a, b in itertools.combinations(sorted(group), 2)}
    pairs = [(a, b) for a, b in met if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    groups = merged_groups([*pairs, *((i, i) for i in range(len(rows)))])
    kept = {r.doc_id for r in simhash.drop_near(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)).collect()}
    assert len(pairs) > 400 and [len(g & kept) for g in groups] == [1] * len(groups)


def test_drop_near_finds_groups_of_all_lengths(spark):
    """Recall and precision on planted chains, from five words to thousands."""
    rng = random.Random(31)
    words = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(6000)]
    rows = []
    for g in range(150):
        base = rng.choices(words, k=rng.choice((5, 12, 30, 80, 300, 900, 4000)))
        for _ in range(rng.randint(1, 5)):
            text = list(base)
            for _ in range(rng.randint(0, len(text) // 45)):
                text[rng.randrange(len(text))] = rng.choice(words)
            rows.append((len(rows), " ".join(text)))
    sets = {i: {" ".join(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in rows}
    groups = merged([*set_links(sets, 0.8), *((i, i) for i in sets)])
    kept = {r.doc_id for r in simhash.drop_near(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)).collect()}
    assert len(groups) < len(rows) - 100 and all(len(g & kept) == 1 for g in groups)


# -- op8 ----------------------------------------------------------------------------------------------------------


def test_language_held_out(spark, awkward, nothing):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(langid.learnable(docs))
    got = langid.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.95
    by = collections.defaultdict(list)
    for r in langid.identify(awkward, model).collect():
        by[r.doc_id].append(r)
    assert {i for i, rs in by.items() if rs[0].lang_pred == "und"} == {3, 4, 5, 9}
    assert len(by[7]) == 2 and by[7][0].score == by[7][1].score and 0 < by[8][0].score <= 1
    assert langid.identify(nothing, model).count() == 0
    assert {r.lang_pred for r in langid.identify(awkward, langid.fit(nothing)).collect()} == {"und"}


def test_every_language_is_learned_however_many(spark, monkeypatch):
    rows = [(i * 500 + k, f"w{i}x word{i} {k}", f"l{i:03d}") for i in range(300) for k in range(2)] + [(-1, "123", "digits")]
    monkeypatch.setattr(langid, "ROWS", 100)
    monkeypatch.setattr(langid, "EPOCHS", 1)
    model = langid.fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    assert model.languages == [f"l{i:03d}" for i in range(300)]


def test_long_texts_bound_the_sample(spark, monkeypatch):
    sizes = []
    monkeypatch.setattr(langid, "train", lambda rows, languages, seed=5: sizes.append((len(rows), languages)))
    docs = spark.range(4000).selectExpr("id AS doc_id", "if(id < 2000, repeat(concat('wort ', id), 50), concat('mot ', id)) AS text", "if(id < 2000, 'a', 'b') AS lang")
    langid.fit(docs)
    monkeypatch.setattr(langid, "FEATURES", 200_000)
    langid.fit(docs)
    (free, both), (bounded, same) = sizes
    assert both == same == ["a", "b"] and free > 2500 and 1450 < bounded < 1800  # about 75 of the long texts, and the short ones as before


def test_means_against_a_naive_mean(monkeypatch):
    rng = random.Random(7)
    monkeypatch.setattr(langid, "PIECE", 256)
    table = np.random.default_rng(1).normal(size=(langid.BUCKETS, 3)).astype(np.float32)
    model = langid.Model(["a", "b", "c"], table, np.zeros(3), 0.0)
    texts = ["".join(rng.choices("abc é你 ", k=rng.choice((1, 5, 40, 900)))) for _ in range(30)]
    for text, got in zip(texts, model.means(texts)):
        data = (" " + text.lower()).encode() + b"    "
        rows = []
        for order in langid.ORDERS:
            for at in range(len(data) - 4):
                h = 0
                for i, c in enumerate(data[at : at + order]):
                    h = c if i == 0 else (h * 0x01000193 & 0xFFFFFFFF) ^ c
                rows.append(table[((h * 0x9E3779B1 + order * 0x3C6EF372) & 0xFFFFFFFF) >> 17])
        assert np.allclose(got, np.mean(rows, axis=0, dtype=np.float64), atol=1e-6)


def test_rejection_keeps_the_wanted_precision(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    got = langid.identify(docs, langid.fit(langid.learnable(docs))).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and not rejected and lang is not null")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] >= langid.PRECISION - 0.02


def test_features_of_pieces_equal_those_of_the_whole(monkeypatch):
    text = "the quick brown fox " * 50
    whole = langid.features(text)
    monkeypatch.setattr(langid, "PIECE", 64)
    cut = langid.features(text)
    assert (whole[0] == cut[0]).all() and np.allclose(whole[1], cut[1])


# -- op9 ----------------------------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style></head><body><nav><ul><li><a href=x>Menu</a></ul></nav><!-- c --><div class="cookie-notice">We use</div>
<article><header><h1>T &amp; U</h1></header><p>a<b>b</b>c  d<p>e&nbsp;f<br>g<script>var x="</p>";</script><div class="share">Share</div>
<section id="comments"><article class="comment"><p>First!</article></section><footer>by me</footer></article><aside>side</aside><form><p>mail</form><footer>&copy;</footer>"""


def test_main_text():
    assert html_text.main_text(PAGE) == "T & U abc d e f g"
    assert html_text.main_text("<body><nav>n<div class=ad>x<article><p>kept &lt;b&gt;</article>") == "kept <b>"
    assert html_text.main_text("<p>one<p>two") == "one two"
    assert html_text.main_text("plain &amp; text") == "plain & text"
    assert html_text.main_text("") == html_text.main_text(None) == html_text.main_text("<script>x") == ""
    assert html_text.main_text("<div>" * 3000 + "deep") == "deep"
    assert html_text.host_of("https://u@A.example.com:80/x?y") == "a.example.com" and html_text.host_of(None) == ""


def test_layout_classes_are_not_noise():
    assert html_text.main_text('<article class="post with-sidebar"><p>hello world</p></article>') == "hello world"
    assert html_text.main_text('<body class="login-ok"><div id=content><p>hello world</p></div></body>') == "hello world"
    assert html_text.main_text('<article><h2 id="social-history">Social</h2><p>x</article>') == "Social x"
    assert html_text.main_text('<div class="site-header">a</div><div class="ad-slot">b</div><div class="reader-comments">c</div><p>d</p>') == "d"


def test_words_of_attribute_values_are_not_attributes():
    assert html_text.main_text('<article><p title="the hidden valley">hello world</p></article>') == "hello world"
    assert html_text.main_text('<blockquote cite="http://x/?id=ad&class=menu">hello world</blockquote>') == "hello world"
    assert html_text.main_text('<p>hello</p><div HIDDEN>no</div><div data-a="1"class=ad>no</div><p style="overflow: hidden">world</p>') == "hello world"


def test_quotes_and_ends_inside_tags():
    assert html_text.main_text("<p class=it's>hello</p><p>world isn't flat</p>") == "hello world isn't flat"
    assert html_text.main_text('<p>hello <a href="x>y">world</a></p><div class="foo') == "hello world"
    assert html_text.main_text("<p>a < b and <3") == "a < b and <3"
    assert html_text.main_text("<p>x</p>" + '<a b="' * 50_001) == "x"


def test_importance_against_brute_force(spark):
    rng = random.Random(17)
    rows = []
    for i in range(120):
        menu, items = rng.randrange(5), "".join(f"<p>text {i} {k}</p>" for k in range(rng.randint(1, 4)))
        rows.append((f"http://h{i % 3}.example/{i}", f"<body><nav>menu {menu}</nav><div class=foot>same</div><div class=text>{items}</div></body>"))
    rows += rows[:10]
    seen = {(html_text.host_of(u), p): html_text.style_nodes(p) for u, p in rows}
    want = collections.defaultdict(lambda: (collections.Counter(), collections.Counter()))
    for (host, _), nodes in seen.items():
        for path, _, presentation, content, _ in nodes:
            want[host, path][0][presentation] += 1
            want[host, path][1][content] += 1

    def entropy(counts, prior):
        each = [*counts.values()] + [1] * prior
        n = sum(each)
        return -sum(c / n * math.log(c / n) for c in each) / math.log(n) if n > 1 else 1.0

    got = {(r.host, r.path): r for r in html_text.importance(spark.createDataFrame(rows, "url string, html string").repartition(3)).collect()}
    assert got.keys() == want.keys()
    for key, (shapes, texts) in want.items():
        assert abs(got[key].importance - (entropy(shapes, 0) + entropy(texts, html_text.PRIOR)) / 2) < 1e-9


def test_the_tree_removes_branches_that_nothing_names(spark, monkeypatch):
    """Without tags, roles and classes to go by, repeated menus, notices and footers go by entropy alone."""
    for name in ("NOISE_TAGS", "NOISE_WORDS", "NOISE_ROLES", "PAGE_HEADERS"):
        monkeypatch.setattr(html_text, name, frozenset())
    rng = random.Random(18)
    pages = [f"<body><div class=a>Menu {i % 4}</div><div class=b><h1>T{i}</h1>{'<p>word %d</p>' % i * rng.randint(1, 4)}</div><div class=c>Notice</div></body>" for i in range(60)]
    df = spark.createDataFrame([(i, f"http://h.example/{i}", p) for i, p in enumerate(pages)], "page_id bigint, url string, html string")
    low = collections.defaultdict(set)
    for r in html_text.importance(df).collect():
        if r.importance < (html_text.LOW_TEXT if r.running else html_text.LOW):
            low["h"].add(r.path)
    for i, p in enumerate(pages):
        n = p.count("<p>")
        assert html_text.main_text(p, low["h"]) == f"T{i}" + f" word {i}" * n
        assert html_text.main_text(p) != html_text.main_text(p, low["h"])


def test_extract_by_site_style_tree(spark):
    page = lambda i: f"<body><article><h1>Title {i}</h1><div class=box{{}}>Same on every page</div><p>Own text {i} {hash(i)}</article></body>"
    rows = [(i, f"http://h.example/{i}", page(i).replace("{}", "")) for i in range(12)]
    rows += [(100, "http://solo.example/", page(100).replace("{}", "")), (101, None, None), (102, "x", ""), (0, "http://h.example/0", page(0).replace("{}", ""))]
    df = spark.createDataFrame([(*r, "z") for r in rows], "page_id bigint, url string, html string, host string")
    got = {r.page_id: r for r in html_text.extract(df).collect()}
    assert got[3].text == f"Title 3 Own text 3 {hash(3)}"  # the branch that never changes is gone
    assert "Same on every page" in got[100].text  # a host of one page tells nothing
    assert got[101].text == "" and got[101].n_chars == 0 and got[102].text == ""
    assert html_text.extract(df).count() == len(rows) and html_text.extract(df.where("false")).count() == 0


def test_copies_of_a_page_keep_their_text(spark):
    page = lambda i, more="": f"<body><div class=site>Every page</div><article><h1>Title {i}</h1><p>Own text {i}</p>{more}</article></body>"
    rows = [("copies.example", page(0)) for _ in range(9)]
    rows += [("two.example", page(i % 2)) for i in range(1000)]
    rows += [("mixed.example", page(i)) for i in range(10)] + [("mixed.example", page(99, "<blockquote>Quoted</blockquote>"))] * 200
    df = spark.createDataFrame([(i, f"http://{h}/{i}", p + f"<!-- {i} -->") for i, (h, p) in enumerate(rows)], "page_id bigint, url string, html string")
    got = {r.page_id: r.text for r in html_text.extract(df).collect()}
    assert {got[i] for i in range(9)} == {"Title 0 Own text 0"}
    assert [got[9 + i] for i in range(1000)] == [f"Title {i % 2} Own text {i % 2}" for i in range(1000)]
    assert [got[1009 + i] for i in range(10)] == [f"Title {i} Own text {i}" for i in range(10)]
    assert {got[1019 + i] for i in range(200)} == {"Title 99 Own text 99 Quoted"}


def test_extract_keeps_articles_whole(spark):
    import html
    import re

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r.text for r in html_text.extract(pages).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)(?:</article>|<footer>)", r.html, re.S)[1]
        inner = re.sub(r"<[^>]*>", "", re.sub(r"</?(p|br|h1)\b[^>]*>", " \x01 ", inner))
        assert got[r.page_id] == " ".join(html.unescape(inner).replace("\x01", " ").split())


# -- op10 ---------------------------------------------------------------------------------------------------------


def test_sketches_merge_and_estimate():
    rng = random.Random(7)
    words = [f"w{i}" for i in range(400)]
    a, b = rng.choices(words, k=3000), rng.choices(words, k=3000)
    one, two = " ".join(a + b[:1500]), " ".join(a[:2000] + b)
    sa, sb = fingerprints.sketch(one), fingerprints.sketch(two)
    x, y = ({tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in (one, two))
    assert abs(fingerprints.resemblance(sa, sb) - len(x & y) / len(x | y)) < 0.15
    assert abs(fingerprints.containment(sa, sb) - len(x & y) / len(x)) < 0.2
    assert abs(fingerprints.distinct(sa) / len(x) - 1) < 0.3
    halves = [" ".join(one.split()[:2004]), " ".join(one.split()[2000:])]
    assert (fingerprints.merge(*map(fingerprints.sketch, halves)) == sa).all()
    assert (fingerprints.parsed(fingerprints.printed(sa)) == sa).all()


def test_fingerprint_neighbours_against_brute_force(awkward, nothing, docs):
    for df in (awkward, docs, docs.limit(1)):
        rows = df.select("doc_id", "text").collect()
        order = sorted(((r.doc_id, r.text or "") for r in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
        want = []
        for k, (i, t) in enumerate(order):
            after = order[(k + 1) % len(order)][1]
            new = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
            s, n, e = map(fingerprints.sketch, (t, after, new))
            want.append((str(i), len(t), hashlib.sha256(new.encode()).hexdigest(), fingerprints.printed(s), fingerprints.printed(e), round(fingerprints.resemblance(s, e), 9), round(fingerprints.resemblance(s, n), 9)))
        got = [(str(r.doc_id), r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in fingerprints.fingerprint_neighbours(df).collect()]
        assert sorted(got) == sorted(want)
    assert fingerprints.fingerprint_neighbours(nothing).count() == 0


def test_columns_named_like_the_operators_own(spark):
    own = ["__n", "__s", "__cdf", "__id", "__gone", "__source", "__u", "id", "node", "n", "u", "cdf", "chunks", "rate", "sha", "kept", "stays", "c0", "tab", "key", "first", "size", "slice", "rank", "bytes"]
    texts = ["one two three four five six", "One two three four five six", "other words are here now and then", "other words are here now and then", None]
    rows = [(i if i < 4 else 3, t, f"s{i % 2}", *(f"{c}{i}" for c in own)) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, ", ".join(f"`{c}` " + ("bigint" if c == "doc_id" else "string") for c in ["doc_id", "text", "source", *own]))
    mixed = mixing.mix(df, {}, epochs=3.0)
    assert mixed.columns == [*df.columns, "copy", "shuffle_key"] and mixed.count() > 0
    for kept in (mixed.drop("copy", "shuffle_key"), exact_dedup.drop_copies(df), simhash.drop_near(df)):
        assert kept.columns == df.columns and {tuple(r) for r in kept.collect()} <= set(rows)
    assert {r.doc_id for r in exact_dedup.drop_copies(df).collect()} == {1, 3} and exact_dedup.drop_copies(df).count() == 3
    for result in (exact_dedup.exact_dedup(df), sharding.shard(df, 2), simhash.near_groups(df), langid.identify(df, langid.fit(df.withColumn("lang", F.lit("x")))), fingerprints.fingerprint_neighbours(df), pieces.sample_pieces(df, 1), toxicity.score(df, toxicity.default_model())):
        assert result.count() == len(rows)


# -- the pipeline -------------------------------------------------------------------------------------------------


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    own = docs
    for name, stage in corpus_pipeline.STAGES[:3]:
        kept = stage(spark, own, SF)
        assert kept.columns == docs.columns
        before, after = {r.doc_id for r in own.collect()}, {r.doc_id for r in kept.collect()}
        assert after <= before
        if name == "exact_dedup":
            want = {}
            for r in own.collect():
                k = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r.text or "")
                want[k] = max(want.get(k, -1), r.doc_id)
            assert after == set(want.values())
        own = kept
    mixed = corpus_pipeline.STAGES[3][1](spark, own, SF)
    assert mixed.columns == docs.columns and {r.doc_id for r in mixed.collect()} <= after
    final = corpus_pipeline.run(spark, SF)
    assert final.columns == ["doc_id", "sample", "ids", "log_prob", "perturbed", "log_inclusion"] and final.count() >= mixed.count()
    assert corpus_pipeline.ORACLE_SQL is None
