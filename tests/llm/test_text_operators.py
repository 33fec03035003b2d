"""Operators on single documents: rules, toxicity, personal data, packing, encoding."""

import hashlib
import itertools
import json
import random
import re
import time
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as public
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from casewise.llm import bpe, host_rules, packing, pii, toxicity

WORD = r"[^\x20\x09-\x0D]+"


def brute_measures(text):
    words = re.findall(WORD, text or "")
    lines = [x for x in (text or "").split("\n") if re.search(WORD, x)]
    grams = Counter(zip(words, words[1:], words[2:]))
    hit = {p for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for p in range(i, i + 3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit)


def test_host_rules(spark, odd, nothing):
    rng = random.Random(3)
    texts = ["\n".join(" ".join(rng.choice(["a", "b", "c#", "dé"]) for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(1, 9))) for _ in range(60)]
    docs = spark.createDataFrame([(i, t, "h") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    for r in host_rules.measure_documents(docs).collect():
        assert tuple(r[m] for m in host_rules.MEASURES) == brute_measures(r.text)
    judged = host_rules.judge_documents(odd)
    assert judged.count() == odd.count() and [c for c in judged.columns if c.lower() == "kept"] == ["kept"]
    assert {r.doc_id for r in judged.where("kept").collect()} == set()
    assert host_rules.judge_documents(nothing).count() == 0


def test_a_bad_host_loses_its_clean_documents(spark):
    good = " ".join(f"w{i}" for i in range(80))
    rows = [(i, "bad", good if i == 0 else "x") for i in range(40)] + [(100 + i, f"h{i % 5}", good) for i in range(50)] + [(900, None, good)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    kept = {r.doc_id for r in host_rules.judge_documents(docs).where("kept").collect()}
    assert kept == {*range(100, 150), 900}
    alpha, beta = host_rules.beta_prior(2, 20.0, 10.0, 200.0, 10.0)
    assert alpha == pytest.approx(beta) and alpha > 0


def slow_kernel(s, t, n, decay):
    total = 0.0
    for i in itertools.combinations(range(len(s)), n):
        for j in itertools.combinations(range(len(t)), n):
            if all(s[a] == t[b] for a, b in zip(i, j)):
                total += decay ** (i[-1] - i[0] + 1 + j[-1] - j[0] + 1)
    return total


def test_subsequence_kernel():
    words = ["^loser", "^lxoser", "^abc", "aabbaab"]
    got = toxicity.kernels(words, toxicity._codes(words, 12, -2), 0.6)
    for (a, s), (b, t), n in itertools.product(enumerate(words), enumerate(words), (3, 4)):
        assert got[n - 3, a, b] == pytest.approx(slow_kernel(s, t, n, 0.6), abs=1e-4)


@pytest.fixture(scope="module")
def labelled():
    rng = random.Random(1)
    syllables = ["an", "er", "th", "on", "in", "re", "st", "ou", "ed", "wh"]

    def text(bad):
        words = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(40)]
        if bad:
            for w in rng.sample(["idiot", "loser", "moron", "pathetic"], 2):
                words.insert(rng.randrange(len(words)), w)
        return " ".join(words)

    return [(text(i % 4 == 0), int(i % 4 == 0)) for i in range(400)]


def test_toxicity_on_held_out_texts(spark, labelled, odd, nothing):
    model = toxicity.fit([t for t, _ in labelled[:300]], [y for _, y in labelled[:300]])
    words = [f"w{i}" for i in range(50)] + ["idiot", "idi-ot", "i d i o t", "scxum"]
    folded = toxicity.normalised([toxicity.spans_of(w)[0] for w in words], model.marks, model.decay, model.mark_width) @ model.weights + model.bias
    assert np.abs(folded - model.span_margins([toxicity.spans_of(w)[0] for w in words])).max() < 1e-4
    docs = spark.createDataFrame([(i, t, y) for i, (t, y) in enumerate(labelled[300:])], "doc_id long, text string, y int")
    rows = toxicity.score_documents(docs, model).collect()
    assert sum((r.score >= 0.5) == (r.y == 1) for r in rows) >= 97
    spelled = spark.createDataFrame([("you i d i o t and l.o.s.e.r",), ("and or the",)], "text string")
    scores = [r.score for r in toxicity.score_documents(spelled, model).collect()]
    assert scores[0] > 0.5 > scores[1]
    got = toxicity.score_documents(odd, model)
    assert got.count() == odd.count() and [c for c in got.columns if c.lower() == "score"] == ["score"]
    assert all(0 <= r.score < 0.5 for r in got.where("text is null or trim(text) = ''").collect())
    assert toxicity.score_documents(nothing, model).count() == 0


def test_no_labels_of_one_kind(spark, odd):
    labels = spark.createDataFrame([(4, 0)], "doc_id long, toxic int")
    assert toxicity.train(odd, labels) is None
    assert {r.score for r in toxicity.score_documents(odd, None).collect()} == {0.0}


def test_training_reads_whole_words_and_no_contradictions(spark):
    bad = [("plainletters" * 2 + "q" + "uvwxzjk" + "plainletters" + " and or", 1) for _ in range(30)]
    good = [("plainletters" * 2 + " and or but so", 0), ("abcdefghijklm plainletters", 0)] * 30
    model = toxicity.fit(*map(list, zip(*(bad + good))))
    scores = [model.probability(model.margins(list(toxicity.words_of(t)))) for t in ("plainletters" * 3 + "quvwxzjk" + "plainletters", "plainletters" * 4)]
    assert scores[0] > 0.5 > scores[1]
    ids = [i for i in range(40) if zlib.crc32(str(i).encode()) % 5]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in zip(ids, bad[:10] + good[:20])], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i in ids[:10] for y in (0, 1)] + [(i, 0) for i in ids[10:30]], "doc_id long, toxic int")
    assert toxicity.train(docs, labels) is None
    agreed = labels.where(f"toxic = 1 or doc_id > {ids[9]}")
    assert toxicity.train(docs, agreed.union(agreed)) is not None


def test_training_holds_a_word_once_however_many_texts_share_it(labelled):
    rng = random.Random(2)
    pool = ["".join(rng.choice("abcdefghij") for _ in range(8)) for _ in range(2_000)]
    texts = [" ".join([t, *rng.sample(pool, 300)]) for t, _ in labelled] * 3
    tracemalloc.start()
    try:
        assert toxicity.fit(texts, [y for _, y in labelled] * 3) is not None
        assert tracemalloc.get_traced_memory()[1] < 25e6
    finally:
        tracemalloc.stop()


def test_training_on_rows_is_training_on_their_texts(spark, labelled):
    ids = [i for i in range(1_000) if zlib.crc32(str(i).encode()) % 5]
    rows = [(i, f"{t} a\x1cb\u00a0c", y) for i, (t, y) in zip(ids, labelled)] + [(ids[len(labelled)], None, 0), (ids[len(labelled) + 1], "", 0)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    got = toxicity.train(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic long"))
    want = toxicity.fit([t or "" for _, t, _ in rows], [y for *_, y in rows])
    assert got.marks == want.marks and np.allclose(got.weights, want.weights) and np.allclose(got.curve, want.curve)


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, reversed(digits)))) % 10 == 0


def brute_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m[0].split(".")), "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}
            if ok[kind]:
                out.append((m.start(), k, m.end(), kind))
    return ",".join(f"{kind}:{s}:{e}" for s, _, e, kind in sorted(out))


def test_personal_data_places(spark, odd, nothing):
    rng = random.Random(5)
    atoms = ["a@b.c", "_d@e.f", "1.2.3.4", ".5", "999.1.1.1", "+1 (988) 555-2485", "4242 4242 4242 4242", "é", "😀", " ", "-", "@", "+", "(", "12", "x.", "4111111111111111"]
    texts = ["".join(rng.choice(atoms) for _ in range(rng.randint(0, 14))) for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    base = F.filter("__c", lambda c: c["base"])
    own = F.array_sort(F.transform(base, lambda c: F.struct(c["s"].alias("s"), c["k"].alias("k"), c["e"].alias("e"))))
    for r in pii.find_candidates(docs).select("text", pii.span_text(own).alias("o")).collect():
        assert r.o == brute_spans(r.text), r.text
    clean = {r.doc_id: r.text for r in pii.redact_documents(odd).collect()}
    assert clean[8] == "é漢字 😀 [EMAIL], [PHONE], [IP], [CARD]" and clean[1] is None and clean[2] == "" and clean[4].startswith("w0 w1")
    assert pii.redact_documents(odd).columns == odd.columns and pii.redact_documents(nothing).count() == 0


def test_reliabilities_from_votes():
    model = pii.estimate({"3|1|1|1|1|2s": 200, "3|1|1|0|1|2s": 300, "3|0|0|0|0|2s": 400, "3|0|1|0|0|2s": 50})
    assert model["3|1|1|1|1|2s"] > 0.7 > 0.4 > model["3|0|0|0|0|2s"]


def test_added_spans_against_a_written_key(spark):
    """Texts with a key: what is between braces is personal data of the kind before it, all else is not."""
    rng, rows = random.Random(4), []
    digest = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    for i in range(400):
        rows.append(rng.choice([
            f'login token = "{{secret:{digest(40)}}}" end', f"api key {{secret:{digest(32)}}} end", "das Donaudampfschifffahrtsgesellschaft fährt",
            f"please call {{phone:({rng.randint(200, 890)}) {rng.randint(200, 999)}-{rng.randint(1000, 9999)}}} now", f"part 123 456-{rng.randint(1000, 9999)} of it",
            f"write to {{email:bob{i}(at)mail.example(dot)org}} soon", f"he came at noon dot to dot {i}", "mail {email:a.b@example.com} or {phone:+1 (555) 123-4567}",
            "card {card:4222222222222} old", f"card 4111 1111 1111 {rng.choice([1112, 1113, 1115])} wrong", "host {ip:2001:db8:85a3:1:2:8a2e:370:7334} up", "plain words only",
        ]))
    texts, keys = [], []
    for row in rows:
        text, key = "", []
        for part in re.split(r"(\{\w+:[^}]*\})", row):
            if part.startswith("{"):
                kind, value = part[1:-1].split(":", 1)
                key.append(f"{kind}:{len(text)}:{len(text) + len(value)}")
                part = value
            text += part
        texts.append(text)
        keys.append(key)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = pii.find_candidates(docs).cache()
    model = pii.span_model(found)
    got = {r.doc_id: r.s.split(",") if r.s else [] for r in found.select("doc_id", pii.span_text(pii.accepted(F.col("__c"), model)).alias("s")).collect()}
    hits = sum(len(set(got[i]) & set(k)) for i, k in enumerate(keys))
    assert hits >= 0.95 * sum(map(len, got.values())) and hits >= 0.95 * sum(map(len, keys))
    clean = {r.doc_id: r.text for r in pii.redact_documents(docs).collect()}
    assert all("[SECRET]" in clean[i] for i, k in enumerate(keys) if k and k[0].startswith("secret"))


def test_many_matches_in_a_text(spark):
    text = " é ".join(f"u{i}@mail.example.com" for i in range(20_000))
    docs = spark.createDataFrame([(1, text), (2, "+1 555 123 4567 " * 40 + "x@y.z")], "doc_id long, text string")
    began = time.perf_counter()
    clean = {r.doc_id: r.text for r in pii.redact_documents(docs).collect()}
    assert clean[1] == " é ".join(["[EMAIL]"] * 20_000) and clean[2].endswith("[EMAIL]") and time.perf_counter() - began < 60
    places = pii.find_candidates(docs.where("doc_id = 1")).select(F.element_at("__c", -1)["e"].alias("e")).first().e
    assert places == len(text)


def test_encoding_equals_the_library(spark, odd, nothing):
    path = public.path("byte_bpe_multi_50k.tiktoken")
    ranks = bpe.read_ranks(path)
    library = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    own, rng, entries = bpe.Codec(path, public.PATTERN), random.Random(2), list(ranks)
    for k in range(3000):
        if k % 2:
            text = b"".join(rng.choice(entries) for _ in range(rng.randint(1, 6))).decode("utf-8", "replace")
        else:
            text = "".join(rng.choice("abcé ñ’'s\t\n\x85\x1c 　ⅷ²12漢字 THE \U0001F600<|endoftext|>") for _ in range(rng.randint(1, 30)))
        ids = [i for unit in own.encode(text) for i in unit[0]]
        assert ids == library.encode_ordinary(text), text
        assert "".join(own.decode(iter(ids), at_once=1 + k % 3)) == text
    for r in bpe.code_documents(odd, path, public.PATTERN, with_ids=True).collect():
        assert hashlib.sha256(r.decoded.encode()).hexdigest() == r.decoded_sha256 and r.n_tokens == len(r.ids)
    assert bpe.code_documents(nothing, path, public.PATTERN).count() == 0


def test_utf8_stream_marks_broken_bytes():
    stream = bpe.Utf8Stream()
    data = "é漢\U0001F600".encode() + b"\xff\xc3" + b"a" + b"\xe6\xbc"
    assert "".join(stream.feed(data[i : i + 1]) for i in range(len(data))) + stream.finish() == data.decode("utf-8", "replace")


@pytest.mark.parametrize("limits", [packing.Limits(), packing.Limits(64, 4, 64, 8), packing.Limits(64, 8, 20, 4), packing.Limits(2048, 16, 600, 64)])
def test_packing_limits(limits):
    rng = random.Random(9)
    got = []
    packer = packing.Packer(limits, lambda *r: got.append(r), 0)
    sizes = [max(1, int(rng.choice([rng.expovariate(0.2), rng.expovariate(1 / limits.tokens), limits.tokens * 3.3, limits.tokens]))) for _ in range(400)]
    for i, size in enumerate(sizes):
        packer.add(i, size, rng.choice([0, size // 2, size]))
    packer.pack(0)
    pieces, sequences = defaultdict(list), defaultdict(list)
    for key, total, start, length, loss, sequence, offset in got:
        pieces[key].append((start, length))
        sequences[sequence].append((offset, length, loss))
    for i, size in enumerate(sizes):
        at = 0
        for start, length in sorted(pieces[i]):
            assert start == at
            at += length
        assert at == size
    for rows in sequences.values():
        at = 0
        for offset, length, _ in sorted(rows):
            assert offset == at
            at += length
        assert at <= limits.tokens and at & (at - 1) == 0 or at == limits.tokens
        assert len(rows) <= limits.segments and sum(r[2] for r in rows) <= limits.loss_tokens


def test_packed_ids(spark, odd, nothing):
    path = public.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    rng = random.Random(12)
    marks = ["a", "é", " the", "'s", "\n", "\t ", "\x85", "　", "²1", "漢", "😀", "<|endoftext|>", "<|endof", " ", "\r\n\n"]
    texts = [r.text for r in odd.collect()] + ["".join(rng.choice(marks) for _ in range(rng.randint(0, 60))) for _ in range(200)] + [" " * 2_000_000 + "x"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    ids = {i: library.encode(t or "", add_special_tokens=False).ids + [1] for i, t in enumerate(texts)}
    at = Counter()
    for r in packing.pack_documents(docs, path, limits=packing.DOCUMENTS, quiet_head=packing.QUIET_HEAD).orderBy("doc_id", "start").collect():
        piece = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4")
        assert (r.start, r.doc_tokens, r.ids_crc32) == (at[r.doc_id], len(ids[r.doc_id]), zlib.crc32(piece.tobytes()))
        at[r.doc_id] += r.length
    assert at == {i: len(x) for i, x in ids.items()}
    whole = packing.pack_documents(odd, path).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert sum(r.n for r in whole) == sum(len(ids[i]) for i in range(odd.count())) and None in {r.doc_id for r in whole}
    assert packing.pack_documents(nothing, path).count() == 0


def test_files_that_ranks_do_not_cover_go_to_the_library(tmp_path):
    path = public.path("byte_bpe_50k.json")
    own = json.loads(open(path, encoding="utf-8").read())
    own["model"]["merges"][:2] = own["model"]["merges"][1::-1]
    (tmp_path / "other.json").write_text(json.dumps(own), encoding="utf-8")
    other = packing.HubTokenizer(str(tmp_path / "other.json"), 1)
    assert packing.HubTokenizer(path, 1).ranks and other.ranks is None
    assert np.frombuffer(other.encode("the end"), "<u4").tolist() == other.library.encode("the end", add_special_tokens=False).ids + [1]
    assert packing.HubTokenizer(public.path("word_bpe_49k.json"), 1).ranks is None


def test_every_limit_binds_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = packing.pack_documents(docs, public.path("byte_bpe_50k.json"), limits=packing.DOCUMENTS, quiet_head=packing.QUIET_HEAD)
    sums = rows.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.count("*").alias("k"), F.sum("loss_tokens").alias("loss")).toPandas()
    limits = packing.DOCUMENTS
    assert (sums["n"].max(), sums["k"].max(), sums["loss"].max()) == (limits.tokens, limits.segments, limits.loss_tokens)
    assert all(n == limits.tokens or n & (n - 1) == 0 for n in sums["n"]) and sums.loc[sums["n"] == limits.tokens, "n"].sum() > 0.95 * sums["n"].sum()


def test_loss_bearing_tokens_of_rows_limit_sequences(spark):
    path = public.path("byte_bpe_50k.json")
    rng = random.Random(11)
    rows = [(i, " ".join(rng.choice(["red", "blue", "seven", "x"]) for _ in range(rng.randint(1, 90))), rng.choice([None, 0, 5, 30, 500])) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, quiet int")
    limits = packing.Limits(64, 8, 20, 16)
    got = packing.pack_documents(docs, path, limits=limits, loss_from="quiet").collect()
    quiet = {i: q or 0 for i, _, q in rows}
    sequences = defaultdict(list)
    for r in got:
        assert r.loss_tokens == max(0, r.start + r.length - max(r.start, quiet[r.doc_id]))
        sequences[r.sequence_id].append(r)
    assert all(sum(r.loss_tokens for r in s) <= 20 for s in sequences.values())
    assert any(sum(r.length for r in s) == 64 and sum(r.loss_tokens for r in s) == 20 for s in sequences.values())
    total = {r.doc_id: r.doc_tokens for r in got}
    assert sum(r.length for r in got) == sum(total.values()) and len(total) == 120
    plain = packing.pack_documents(docs, path).collect()
    assert all(r.loss_tokens == r.length for r in plain)
