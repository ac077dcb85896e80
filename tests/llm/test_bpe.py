"""BPE against the tokenizers library (ids and decoded text)."""

import random

from tokenizers import Tokenizer

from sway.llm import bpe

TOK = Tokenizer.from_file(bpe.default_path())


def library(text):
    return TOK.encode(text or "", add_special_tokens=False).ids


def test_every_token_and_random_texts():
    enc = bpe.encoder(bpe.default_path())
    rng = random.Random(1)
    texts = [t.decode("utf-8") for t in enc.v.id_of if not any(b > 127 for b in t)][:20000]
    alphabet = "aaaabcdeehhiillnnoorssttuu  ''\n\t.,!ßéü漢🙂1234<|>"
    texts += ["".join(rng.choices(alphabet, k=rng.randrange(1, 60))) for _ in range(4000)]
    texts += ["a" * n for n in range(1, 70)] + ["ab" * 40, " " * 50, "\n \n\t x", "it's we'll I'VE", "<|endoftext|>", "x<|endoftext|> y <|endoftext|>"]
    got = enc.encode(texts)
    for t, g in zip(texts, got, strict=True):
        ids = library(t)
        assert g.tolist() == ids, t
        assert enc.decode(ids) == TOK.decode(ids, skip_special_tokens=False)


def test_every_code_point_is_split_alike():
    enc = bpe.encoder(bpe.default_path())
    points = [c for c in range(0x20000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{chr(c)}{chr(c)} {chr(c)}b " for c in points[i:i + 64]) for i in range(0, len(points), 64)]
    bad = [i for i, (t, g) in enumerate(zip(texts, enc.encode(texts), strict=True)) if g.tolist() != library(t)]
    assert not bad, bad


def test_small_bounds_give_the_same_ids(monkeypatch):
    monkeypatch.setattr(bpe, "KEPT_WORDS", 20)
    monkeypatch.setattr(bpe, "TRIE_WORDS", 3)
    monkeypatch.setattr(bpe, "SLICE_WORDS", 50)
    enc = bpe.Encoder(bpe.Vocabulary(bpe.default_path()))
    rng = random.Random(2)
    texts = [" ".join("".join(rng.choices("theandior", k=rng.randrange(1, 70))) for _ in range(30)) for _ in range(20)] * 2
    assert [g.tolist() for g in enc.encode(texts[:10])] + [g.tolist() for g in enc.encode(texts[10:])] == [library(t) for t in texts]


def test_table_with_edges(docs):
    rows = [(1, "Hello world"), (2, None), (3, ""), (4, "x" * 30000 + " " + "word " * 60000), (None, "  two\n"), (1, "Hello world")]
    out = bpe.encode(docs(rows, token_ids2=1, decoded="clash"), decoded="decoded_text").collect()
    assert len(out) == len(rows)
    want = sorted((r[0] or 0, library(r[1]), r[1] or "") for r in rows)
    assert sorted((r["doc_id"] or 0, r["token_ids"], r["decoded_text"]) for r in out) == want
    back = bpe.decode(bpe.encode(docs(rows))).collect()
    assert sorted((r["doc_id"] or 0, r["decoded"]) for r in back) == sorted((r[0] or 0, r[1] or "") for r in rows)
    assert bpe.encode(docs([])).count() == 0
