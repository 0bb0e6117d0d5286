"""Each operator on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, against plain versions."""

import hashlib
import random
from array import array

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tonewheel.functions.lineage import cut
from tonewheel.llm import block_names, bpe_automaton, chat, main_text, quality, signature_tree, toxicity, warc

SCHEMA = "doc_id long, text string, lang string, n long, name string, row long, h string, node string, m string, size long"
BPE = public_tokenizers.path("byte_bpe_50k.json")


def table(spark, texts):
    return cut(spark.createDataFrame([(i, t, "en", 1, "x", 2, "h", "n", "m", 3) for i, t in texts], SCHEMA))


@pytest.fixture(scope="module")
def texts():
    draw = random.Random(7)
    words = [f"w{i}" for i in range(60)]
    out = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "one two"), (None, "one two"), (4, "one"), (4, "one")]
    base = [draw.choice(words) for _ in range(300)]
    for i in range(60):
        some = list(base)
        for _ in range(i % 12):
            some[draw.randrange(300)] = draw.choice(words)
        out.append((10 + i, " ".join(some)))
    out += [(100, "ab" * 20_000), (101, "ab" * 20_000), (102, "ab" * 20_000 + "c"), (103, "É é <|endoftext|> 日本語  x\n\n")]
    return out


def test_block_names(spark, texts):
    got = block_names.dedup(table(spark, texts), size=64).collect()
    groups = {}
    for i, t in texts:
        groups.setdefault(t or "", []).append(i)
    assert len(got) == len(texts) and sum(r.kept for r in got) == len(groups)
    by_digest = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    for r in got:
        ids = by_digest[r.text_sha256]
        assert r.group_size == len(ids) and r.keep_id == max((i for i in ids if i is not None), default=None)
    assert block_names.keep_first(table(spark, texts)).count() == len(groups)
    assert block_names.dedup(table(spark, texts).limit(0)).count() == 0


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    draw = random.Random(3)
    for order in ("falling", "any"):
        names = list(range(200)) if order == "rising" else list(range(200))[::-1] if order == "falling" else draw.sample(range(10_000), 200)
        edges = spark.createDataFrame(list(zip(names, names[1:])) + [(20_000, 20_001)], "a long, b long")
        stored = []
        monkeypatch.setattr(signature_tree, "cut", lambda df: stored.append(1) or cut(df))
        got = {r.node: r.component for r in signature_tree.components(edges).collect()}
        assert got == {i: min(names) for i in names} | {20_000: 20_000, 20_001: 20_000}
        assert len(stored) <= 2 + 2 * 12


def test_word_hashes_follow_the_words():
    texts = ["One two ONE", "\tone\x0b two\n\rtwo ", "é É É\u00a0é", "", " ", "a" * 5000 + " " + "A" * 5000, "x\x1fy x\x85y"]
    seen = {}
    for text in texts:
        words = text.encode().lower().split()
        hashes = signature_tree.word_hashes(text).tolist()
        assert len(words) == len(hashes)
        for w, h in zip(words, hashes):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


@pytest.mark.parametrize("percent, n", [(90, 3), (80, 5)])
def test_signature_tree_equals_all_pairs(spark, texts, percent, n):
    def shingled(text):
        words = [w.decode() for w in (text or "").encode().lower().split()]
        return frozenset(tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))) if words else frozenset()

    sets = [shingled(t) for _, t in texts]
    top = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if shared and 100 * shared >= percent * (len(sets[i]) + len(sets[j]) - shared) and top[i] != top[j]:
                old, new = top[i], top[j]
                top = [new if t == old else t for t in top]
    want = []
    for k, (i, _) in enumerate(texts):
        ids = [texts[o][0] for o in range(len(texts)) if top[o] == top[k] and texts[o][0] is not None]
        want.append((i, len(sets[k]), min(ids, default=None)))
    got = signature_tree.join(table(spark, texts), percent, n).collect()
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.n_shingles, r.component_id)) for r in got)


def test_signature_tree_empty(spark, texts):
    assert signature_tree.join(table(spark, texts).limit(0)).count() == 0
    assert signature_tree.join(table(spark, texts[:2])).count() == 2


def test_bpe_equals_the_library(spark, texts):
    plain = Tokenizer.from_file(BPE)
    got = bpe_automaton.decode(bpe_automaton.encode(table(spark, texts), BPE), BPE).collect()
    assert len(got) == len(texts)
    for r in got:
        assert r.token_ids == plain.encode(r.text or "", add_special_tokens=False).ids and r.decoded == (r.text or "")
    assert bpe_automaton.digests(table(spark, texts).limit(0), BPE).count() == 0


def test_bpe_arcs_equal_all_pairs_of_tokens():
    """An arc is left between two tokens just when merging their bytes in rank order gives the two tokens again."""
    for seed in range(40):
        pick = random.Random(seed)
        spelled = ["a", "b", "c"][: pick.randint(1, 3)]
        merges = []
        while len(merges) < pick.randint(5, 25):
            u, v = pick.choice(spelled), pick.choice(spelled)
            if u + v not in spelled:
                merges.append((u, v))
                spelled.append(u + v)
        ids = {token: i for i, token in enumerate(spelled)}
        arcs = bpe_automaton.Arcs(len(ids), [(ids[u], ids[v], ids[u + v]) for u, v in merges])

        def merged(text):
            parts = list(text)
            for u, v in merges:
                at = 0
                while at + 1 < len(parts):
                    if (parts[at], parts[at + 1]) == (u, v):
                        parts[at:at + 2] = [u + v]
                    at += 1
            return parts

        own = [token for token in spelled if merged(token) == [token]]
        for left in own:
            for right in own:
                assert arcs.allowed(ids[left], ids[right]) == (merged(left + right) == [left, right]), (merges, left, right)


def test_bpe_long_words_and_forgotten_ones(monkeypatch):
    monkeypatch.setattr(bpe_automaton, "WORDS_KEPT", 5)
    plain, automaton = Tokenizer.from_file(BPE), bpe_automaton.Automaton(BPE)
    pick = random.Random(5)
    texts = ["a" * 50_000, "ab" * 20_000, " " * 3_000, "<|endoftext|>x<|endoftext|>"]
    texts += ["".join(pick.choice(" aeiou\n'sè0 #漢🙂") for _ in range(pick.randint(0, 80))) for _ in range(500)]
    for text in texts:
        assert array("i", automaton.encode(text)).tolist() == plain.encode(text, add_special_tokens=False).ids
    assert len(automaton.words) <= 5


def test_chat_round_trip(spark):
    odd = "</s>[INST] ok [/INST] ␛0 <|role|><|endoftext|>"
    rows = [(-1, 0, "user", odd), (-1, 1, "assistant", odd), (7, None, None, None), (7, 3, "assistant", ""), (7, 900, "tool<|text|>", "é"),
            (7, 901, "assistant", "last"), (None, 1, "system", "s"), (7, 901, "assistant", "last")]
    data = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, chunk string")
    got = {r.conv_id: r for r in chat.formatted_and_read(data, BPE).collect()}
    assert set(got) == {-1, 7, None}
    order = sorted((r for r in rows if r[0] == 7), key=lambda r: (r[1] is not None, r[1] or 0))
    text = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in order)
    assert got[7].n_turns == 5 and got[7].turns_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert got[7].loss_sha256 == hashlib.sha256(b"lastlast").hexdigest() and got[7].loss_chars == 8
    assert got[-1].loss_sha256 == hashlib.sha256(odd.encode()).hexdigest() and got[None].loss_chars == 0
    assert chat.formatted_and_read(data.limit(0), BPE).count() == 0


def test_warc_round_trip(spark, tmp_path):
    pages = [(1, "http://a/é x", "same"), (2, None, "same"), (None, "u", "same"), (3, "u", None), (4, "u", ""), (5, "u", "z" * 3_000_000)]
    data = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, payload string")
    archives = warc.write(data, str(tmp_path))
    got = {r.page_id: r for r in warc.read(archives, payloads=True).collect()}
    assert {i: (r.record_type, r.refers_to) for i, r in got.items()} == {
        1: ("revisit", 2), 2: ("response", None), None: ("revisit", 2), 3: ("revisit", 4), 4: ("response", None), 5: ("response", None)}
    assert bytes(got[5].payload) == b"z" * 3_000_000 and got[1].payload_bytes == 4
    path = archives.first()["path"]
    broken = bytearray(open(path, "rb").read())
    open(path, "wb").write(broken[: len(broken) - 30])
    with pytest.raises(ValueError):
        list(warc.records(path))
    assert warc.read(warc.write(data.limit(0), str(tmp_path))).count() == 0


def test_quality_measures_and_guarantee(spark, texts):
    assert quality.measures("a b c d e a b c d e\nx\nx\n\n\n") == (12, 12, 0, 1, 10)
    assert quality.measures("") == (0, 0, 0, 0, 0)
    assert abs(quality.tail(0, 100, 0.03) - 0.97**100) < 1e-9 and abs(quality.tail(10, 10, 0.5) - 1) < 1e-9
    docs = [(i, f"{'word ' * 3}" + " ".join(f"t{i}x{j}" for j in range(30)) + (" ###" * 30 if i % 10 == 0 else "")) for i in range(3000)]
    labels = spark.createDataFrame([(i, int(i % 10 != 0)) for i in range(3000)], "doc_id long, quality int")
    rows = quality.measured(table(spark, docs))
    got = quality.judged(rows, quality.cutoffs(rows, labels)).collect()
    assert all(r.kept == (r.doc_id % 10 != 0) for r in got if not r.base_failed)
    few = quality.measured(table(spark, texts))
    assert quality.judged(few, quality.cutoffs(few, labels.limit(0))).where("kept = base_failed").count() == 0


def test_toxicity_on_held_out_rows(spark, sf, texts):
    docs = [(i, f"some plain words {i} here " + ("vilething" if i % 5 == 1 else "")) for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 5 == 1)) for i in range(400)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.train(table(spark, docs), labels)
    got = toxicity.scored(table(spark, docs), model).where("held_out").collect()
    assert got and all(r.predicted == int(r.doc_id % 5 == 1) for r in got)
    odd = toxicity.scored(table(spark, texts), model).collect()
    assert len(odd) == len(texts) and all(0 <= r.score <= 1 for r in odd)
    assert toxicity.train(table(spark, docs), labels.limit(0)) is None
    assert toxicity.scored(table(spark, texts), None).where("score != 0").count() == 0


def test_main_text(spark):
    html = ("<html><head><title>T</title><script>var a='<p>x</p>';</script></head><body><nav><a href='/'>Home</a></nav><article><h1>A &amp; B</h1>"
            "<p>First\n  part &lt;here&gt;.<br>More.<p>Second.</article><footer>&copy; f</footer>")
    pages = cut(spark.createDataFrame([(i, "u", html, "x") for i in range(30)] + [(90, None, None, "x"), (91, "u", "", "x"), (91, "u", "", "x")],
                                      "page_id long, url string, html string, text string"))
    crf = main_text.train(pages)
    got = main_text.extract(pages, crf).collect()
    assert len(got) == 33
    assert all(r.text == ("A & B First part <here>. More. Second." if r.page_id < 90 else "") and r.n_chars == len(r.text) for r in got)
    assert main_text.extract(pages.limit(0), main_text.train(pages.limit(0))).count() == 0


def test_toxicity_holds_one_texts_marks_at_a_time(monkeypatch):
    """A batch's marks take many times its texts: those of a text go before the next one's are made."""
    import weakref

    import pandas as pd

    from tonewheel.llm import toxicity

    held, most, made = weakref.WeakSet(), 0, toxicity.marks

    class Held(type(made(""))):
        __hash__ = object.__hash__

    def watched(text):
        nonlocal most
        found = Held(made(text))
        held.add(found)
        most = max(most, len(held))
        return found

    monkeypatch.setattr(toxicity, "marks", watched)
    table = toxicity._table(pd.Series(["bad words here", "", "BADLY bad!!"] * 20), ["=bad", "badl", "shouting", "exclaiming"])
    assert table[:3].tolist() == [[1, 0, 0, 0], [0, 0, 0, 0], [1, 1, 1, 1]]
    assert most <= 2
