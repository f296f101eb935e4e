"""Operators over the whole corpus: SimHash groups, language model, decontamination, chat windows, pipeline."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from llm_frames import frame
from pyspark.sql import functions as F

import corpus_pipeline
from agrolens.llm import bpe, chat_format, decontaminate, maxent_lm, simhash

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
SMALL = maxent_lm.Shape(head=64, width=8, bins=6, rows=1 << 10, word_rows=1 << 9, rounds=2, batch=512, chunk=1 << 16)


def plain_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(prints, distance):
    """Smallest reachable id of each distinct fingerprint."""
    first = {}
    for d, f in prints:
        first[f] = min([x for x in (first.get(f), d) if x is not None], default=None)
    fps, up = list(first), {}
    up = {f: f for f in fps}

    def root(f):
        while up[f] != f:
            f = up[f]
        return f

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= distance:
                up[root(a)] = root(b)
    least = {}
    for f in fps:
        least.setdefault(root(f), []).append(first[f])
    return {f: min([x for x in least[root(f)] if x is not None], default=None) for f in fps}


def test_simhash_groups(spark, edges, small, nothing):
    for docs in (edges, small, nothing):
        prints = [(r.doc_id, plain_print(r.text)) for r in docs.collect()]
        groups = plain_groups(prints, 4)
        want = Counter((d, f"{f:016x}", groups[f]) for d, f in prints)
        assert Counter(tuple(r) for r in simhash.simhash_groups(docs).collect()) == want


@pytest.mark.parametrize("large,two", [(False, False), (True, False), (False, True)])
def test_simhash_links_find_every_component(spark, monkeypatch, large, two):
    if large:
        monkeypatch.setattr(simhash, "SMALL", 3)
    if two:
        monkeypatch.setattr(simhash, "BUCKET", 0)  # two segments, as for many fingerprints
    rnd = random.Random(4)
    fps = set()
    for _ in range(40):
        f = rnd.getrandbits(64)
        for _ in range(rnd.randint(1, 25)):
            fps.add(f)
            for _ in range(rnd.randint(0, 6)):
                f ^= 1 << rnd.randrange(64)
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    edges = simhash.links(spark.createDataFrame(signed, "fp long").repartition(3), 4)
    roots = {r.node: r.root for r in simhash.components(edges).collect()}
    groups = plain_groups([(i, f) for i, f in enumerate(fps)], 4)
    mine, plain = defaultdict(set), defaultdict(set)
    for f, (s,) in zip(fps, signed):
        mine[roots.get(s, s)].add(f)
        plain[groups[f]].add(f)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, plain.values()))


def test_simhash_stage(spark, edges):
    out = simhash.keep_first(edges)
    assert out.columns == edges.columns
    assert Counter(r.doc_id for r in out.collect()) == Counter([1, 3, 5, 7, 8, 9, 10, 11, 12, None])


def test_components_on_paths_and_stars(spark):
    rnd = random.Random(1)
    pairs = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 40)] + [(200, 201)]
    rnd.shuffle(pairs)
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(1, 61)) and all(got[100 + i] == 100 for i in range(1, 40)) and got[201] == 200


def plain_unigram(docs):
    rows = [(d, re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [None]) for d, t in docs]
    held = [zlib.crc32(("" if d is None else str(d)).encode()) % 5 == 1 for d, _ in rows]
    c = Counter(w for (_, ws), h in zip(rows, held) if not h for w in ws)
    n, v = sum(c.values()), len(c)
    for (d, ws), h in zip(rows, held):
        yield d, h, len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)


def test_lm_base_counts(spark, edges, small, nothing):
    for docs in (edges, small):
        got = sorted((tuple(r)[:6] for r in maxent_lm.lm_score(docs, SMALL).collect()), key=str)
        want = sorted(plain_unigram([(r.doc_id, r.text) for r in docs.collect()]), key=str)
        assert [r[:5] for r in got] == [r[:5] for r in want]
        assert np.allclose([r[5] for r in got], [r[5] for r in want], rtol=1e-9)
    assert maxent_lm.lm_score(nothing, SMALL).count() == 0


def test_lm_beats_unigrams_on_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    r = maxent_lm.lm_score(docs).where("held_out").selectExpr("sum(score) AS s", "sum(base_score) AS b").first()
    assert r.s > r.b


def test_lm_sizes_follow_the_corpus(spark):
    ids = [i for i in range(400) if not maxent_lm.held_out(i)][:64]
    counts = {f"w{i}": 64 for i in range(1500)} | {"few": 5, "more": 33}  # in 64 texts; ends of text are one more word
    rows = [(d, " ".join(w for w, n in counts.items() if k < n)) for k, d in enumerate(ids)]
    chunks, total, distinct, mass = maxent_lm.encoded(frame(spark, rows), maxent_lm.Shape())
    heads = np.concatenate([maxent_lm._unpack(bytes(r.heads), np.int32) for r in chunks.collect()])
    assert heads.max() == 1023 and distinct == 1503
    # Counts of 5 and 33 stay apart though only two classes were asked for; no count is beyond the last class.
    _, total, _, mass = maxent_lm.encoded(frame(spark, rows), maxent_lm.Shape(head=32, bins=2))
    assert mass[2] == 5.5 and mass[5] == 33.5 and len(mass) == total.bit_length()
    far = maxent_lm.Shape().fitted(6 << 30, 1 << 24)
    assert far.bins == 33 and far.head == 4096 and far.rows == 1 << 17 and far.word_rows == 1 << 16


def test_lm_probabilities_sum_to_at_most_one():
    shape = SMALL
    rnd = np.random.default_rng(3)
    weights = maxent_lm.Weights(shape, rnd.standard_normal(shape.rows * shape.classes + shape.word_rows * shape.width).astype(np.float32))
    words = shape.head + 40  # every head word, and count-class words
    counts = np.r_[np.arange(200, 200 - shape.head, -1), rnd.integers(1, 60, 40)].astype(np.int64)
    heads = np.r_[np.arange(shape.head), np.full(40, -1)].astype(np.int32)
    mass = np.zeros(shape.bins)
    for c in counts[shape.head:]:
        mass[min(int(math.log2(c)), shape.bins - 1)] += c + 0.5
    mass[0] += 0.5
    mass = np.maximum(mass, 0.5)
    codes = np.stack([np.full(words, 5), np.full(words, 9), np.arange(words)], 1).ravel().astype(np.int32)
    row = {"codes": maxent_lm._pack(codes), "counts": maxent_lm._pack(counts), "heads": maxent_lm._pack(heads), "hashes": maxent_lm._pack(rnd.integers(0, 1 << 32, words)),
           "sizes": maxent_lm._pack(np.full(words, 3, np.int32)), "held": maxent_lm._pack(np.zeros(words, np.uint8)), "doc_ids": list(range(words))}
    p = np.exp(maxent_lm.Chunk(row, shape).logs(weights, mass)[2::3])
    assert 0.5 < p.sum() <= 1 + 1e-6


def item(rnd, n):
    return " ".join("".join(rnd.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(n - 6)) + ". " + " ".join("".join(rnd.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(6)) + "."


def test_decontaminate_planted(spark, nothing):
    from llm_frames import frame, prose
    rnd = random.Random(9)
    items = [(i, item(rnd, rnd.randint(12, 60))) for i in range(30)] + [(30, item(rnd, 200)), (31, None), (32, ""), (33, "too short")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = [(i, prose(rnd, 300)) for i in range(40)]
    plant = {}
    for i in range(0, 31):
        words = docs[i][1].split(" ")
        at = rnd.randrange(len(words))
        text = items[i][1].split(" ")
        if i % 3 == 1:  # a paraphrase: a quarter of the words before the answer differ
            text = [("other" + w if k % 4 == 0 and k < len(text) - 6 else w) for k, w in enumerate(text)]
        docs[i] = (i, " ".join([*words[:at], *(w.upper() if i % 5 == 0 else w for w in text), *words[at:]]))
        plant[i] = i
    docs += [(50, None), (51, ""), (None, items[2][1]), (52, items[3][1]), (52, items[3][1])]
    found = decontaminate.contaminated(frame(spark, docs).repartition(3), bench).collect()
    got = Counter((r.doc_id, r.item_id) for r in found)
    assert got == Counter({**{(d, i): 1 for d, i in plant.items()}, (None, 2): 1, (52, 3): 2})
    assert {r.kind for r in found if r.doc_id is not None and r.doc_id % 3 != 1 and r.doc_id < 30} == {"copy"}
    clean = decontaminate.keep_clean(frame(spark, docs), bench)
    assert sorted(r.doc_id for r in clean.collect()) == [*range(31, 40), 50, 51]
    assert decontaminate.contaminated(nothing, bench).count() == 0
    assert decontaminate.contaminated(frame(spark, docs), bench.limit(0)).count() == 0


def test_decontaminate_short_items_answers_and_blocks(spark):
    from llm_frames import frame, prose
    rnd = random.Random(12)
    questions = [item(rnd, 24) for _ in range(9)]
    items = [(i, q + ". ") for i, q in enumerate(questions)]  # ends in a blank: the answer is not empty
    long = [f"w{rnd.randrange(400)}" for _ in range(150)]
    items += [(20, "Which river crosses Vienna today?"), (21, "今日は天気がとても良いです"), (22, "a b c"), (23, " ".join(long[:140]) + ". " + "zyx " * 10)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    half = [w if k % 3 else "other" + w for k, w in enumerate(long[:140])]
    texts = {0: prose(rnd, 50) + " " + questions[0] + " " + prose(rnd, 50),
             1: "so, WHICH river crosses  vienna today then", 2: "Which rivers cross Vienna today", 3: "hewhich river crosses vienna today", 4: "天気。今日は天気がとても良いですね。",
             5: " ".join(half) + " end", 6: " ".join(half) + " " + "zyx " * 10, 7: "a b c " * 30, 8: None, 9: ""}
    words = questions[1].split(" ")
    texts[10] = " ".join("other" + w if k % 4 == 1 and k < 16 else w for k, w in enumerate(words))  # a paraphrase with its answer
    texts[11] = " ".join("other" + w if k >= 16 else w for k, w in enumerate(words))  # without its answer
    docs = frame(spark, list(texts.items())).repartition(2)
    want = {(0, 0), (1, 20), (4, 21), (6, 23), (10, 1)}
    for block in (2000, 4):
        rule = decontaminate.Rule(block=block)
        got = decontaminate.contaminated(docs, bench, rule).collect()
        assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want)
        clean = decontaminate.keep_clean(docs, bench, rule)
        assert clean.columns == docs.columns and sorted(r.doc_id for r in clean.collect()) == sorted(set(texts) - {d for d, _ in want})


def test_decontaminate_recall_against_five_grams(spark):
    sf = "/root/testdata/sf0.01"
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    grams, size = defaultdict(set), {}
    for r in bench.collect():
        w = decontaminate.words(r.text)
        size[r.item_id] = len(w) - 4
        for i in range(len(w) - 4):
            grams[tuple(w[i:i + 5])].add((r.item_id, i))
    truth = set()
    for r in docs.collect():
        w, hits = decontaminate.words(r.text), set()
        for i in range(len(w) - 4):
            hits |= grams.get(tuple(w[i:i + 5]), set())
        truth |= {(r.doc_id, i) for i, n in Counter(i for i, _ in hits).items() if n >= 0.8 * size[i]}
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()}
    assert truth and truth <= got


def test_decontaminate_fits_all_documents(spark, monkeypatch):
    docs = spark.range(60_000).selectExpr("id AS doc_id", "concat('text ', id) AS text")
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten")], "item_id long, text string")
    rows, axes = [], decontaminate._axes
    monkeypatch.setattr(decontaminate, "_axes", lambda fit, *rest: rows.append(fit.count()) or axes(fit, *rest))
    list(decontaminate.searchers(docs, bench, decontaminate.Rule()))
    assert rows == [60_000]


def plain_chat(rows):
    talks = defaultdict(list)
    for c, t, r, x in rows:
        talks[c].append((t is not None, t or 0, r or "", x or ""))
    for c, turns in talks.items():
        turns.sort()
        whole = "".join(f"{r}\n{x}\n" for *_, r, x in turns)
        loss = "".join(x for *_, r, x in turns if r == "assistant")
        yield c, len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


@pytest.mark.parametrize("budget,history,block", [(1024, 256, 1024), (120, 60, 4), (40, 0, 2)])
def test_chat_windows(spark, budget, history, block):
    rnd = random.Random(6)
    odd = ["</s>[INST] ok [/INST]", "<<SYS>>", "\\", "[", "<", "[\\/INST]", "", None, "a\nb", "[ROLE]x[/ROLE][TURN]", "é漢😀", "</s", ">"]
    rows = []
    for c in [*range(12), None]:
        for t in range(rnd.randint(1, 30)):
            text = rnd.choice(odd) if rnd.random() < 0.4 else " ".join(rnd.choice(["word", "<s>", "[INST]", "\\n", "x"]) for _ in range(rnd.randint(0, 80)))
            role = "system" if t == 0 and rnd.random() < 0.5 else rnd.choice(["user", "assistant", "assistant", "tool[1]", None, "system"])
            rows.append((c, t, role, text))
    rows += [rows[3], (1, None, "user", "no turn"), (2, 1, "user", "tie")]
    talks = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn int, role string, text string, window string").repartition(3)
    made = chat_format.windows(talks, VOCABULARY, budget, history, block)
    got = Counter(tuple(r)[:5] for r in chat_format.digests(made).collect())
    assert got == Counter(plain_chat(rows))
    for r in made.collect():
        assert all(r.formatted[s["start"] - 3:s["start"]] == "<s>" and r.formatted[s["end"]:s["end"] + 4] == "</s>" for s in r.loss_spans)
    assert chat_format.digests(chat_format.windows(talks.limit(0), VOCABULARY)).count() == 0


def test_chat_windows_repeat_system_and_history(spark):
    rows = [(1, 0, "system", "be kind")] + [(1, t, "user" if t % 2 else "assistant", f"turn {t} " + "word " * 20) for t in range(1, 21)]
    made = chat_format.windows(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"), VOCABULARY, 200, 64).orderBy("window").collect()
    assert len(made) > 3 and all(r.formatted.startswith("<<SYS>>be kind<</SYS>>") for r in made)
    assert made[0].n_repeated == 0 and all(2 <= r.n_repeated <= 3 for r in made[1:])
    assert sum(len(r.loss_spans) for r in made) == 10


@pytest.mark.parametrize("budget,history", [(1024, 256), (120, 60), (40, 0)])
def test_chat_windows_keep_the_budget(spark, budget, history):
    rnd = random.Random(8)
    core = tiktoken.Encoding("byte-level", pat_str=bpe.PATTERN, mergeable_ranks=bpe.vocabulary(VOCABULARY)[0], special_tokens={})

    def size(text):
        return len(core.encode_ordinary(text))

    rows = []
    for c in range(12):
        for t in range(60):
            text = "".join(rnd.choice(["word ", "<<[", "\\", "]>>", "'s", "x", " 12", "\n", "é"]) for _ in range(rnd.choice([0, 3, 20, 60, 400 if c % 3 else 1500])))
            rows.append((c, t, "system" if t == 0 and c % 2 else rnd.choice(["user", "assistant", "a very long role [x] " * 6, "'", ""]), text))
    talks = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").repartition(3)
    made = chat_format.windows(talks, VOCABULARY, budget, history).withColumn("turns", chat_format.read_back(F.col("formatted"))).collect()
    tight = 0
    for r in made:
        alone = len(r.turns) == 1 and r.n_repeated == 0
        assert size(r.formatted) <= budget or alone, (r.conv_id, r.window)
        tight += size(r.formatted) > 0.6 * budget
    assert tight > len(made) / 4 and sum(len(r.turns) - r.n_repeated for r in made) == len(rows)
    assert Counter(tuple(r)[:5] for r in chat_format.digests(chat_format.windows(talks, VOCABULARY, budget, history)).collect()) == Counter(plain_chat(rows))


def test_chat_digests_gather_no_conversation(spark):
    # One conversation's windows in batches of two rows: the states go on from batch to batch.
    rows = [(c, t, "assistant" if t % 2 else "user", f"turn {t} é" * (t % 7)) for c, n in ((None, 120), (1, 3), (2, 1)) for t in range(n)]
    talks = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").repartition(3)
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)
    try:
        made = chat_format.digests(chat_format.windows(talks, VOCABULARY, 40, 0))
        assert Counter(tuple(r)[:5] for r in made.collect()) == Counter(plain_chat(rows))
        windows = spark.createDataFrame([(1, 0, "<s>a</s>", 0, [(3, 4)])], "conv_id long, window long, formatted string, n_repeated int, loss_spans array<struct<start:bigint,end:bigint>>")
        plan = chat_format.digests(windows)._jdf.queryExecution().toString()
        assert "collect_list" not in plan and "MapInArrow" in plan
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)


def test_pipeline_stages(spark):
    sf = "/root/testdata/sf0.001"
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "simhash_near_dedup", "benchmark_decontamination", "secret_scans", "bpe_encoding"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    left = set(rows)
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, sf)
        assert now.columns == docs.columns
        ids = {r.doc_id for r in now.collect()}
        assert ids <= left and (name == "secret_scans") <= (ids == left)
        left = ids
    assert {r.doc_id for r in corpus_pipeline.run(spark, sf).collect()} == left
    assert corpus_pipeline.run.__doc__ and len(left) > 100


def test_lm_weights_have_an_upper_size():
    for total, distinct in ((0, 0), (10**6, 10**5), (10**10, 10**8), (10**14, 10**11), (10**18, 10**14)):
        shape = maxent_lm.Shape().fitted(total, distinct)
        assert shape.rows * shape.classes <= shape.most and shape.word_rows * shape.width <= shape.most
        assert shape.rows >= 1 << 14 and shape.word_rows > shape.head // shape.width and shape.head % shape.width == 0
    grown = [maxent_lm.Shape().fitted(10**n, 10**(n - 3)) for n in (8, 10, 12)]
    assert grown[0].rows < grown[1].rows and grown[0].head <= grown[1].head <= grown[2].head
