"""A run of texts is encoded as a whole: its unseen words reach the tokenizer together."""

import random

import numpy as np
import pyarrow as pa

from recsift.llm import packing
from recsift.llm.queries import tokenizer_path


def _texts():
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefgh\u00e4\u00d6\u00f1", k=rng.randint(1, 9))) for _ in range(400)]
    marks = ["", "", ".", ",)", "!!", "'s", "1", "\u4e2d", " ", "\n", "\t"]
    texts = ["".join(rng.choice([w, w.upper(), w.title()]) + rng.choice(marks) + " " for w in rng.choices(words, k=60))
             for _ in range(40)]
    return [None, "", " ", "a", "x" * 200, "<|endoftext|>", "a<|endoftext|>b <|endoftext|>", "<|ENDOFTEXT|> end", *texts, "", None]


def test_runs_of_texts_get_the_tokenizer_s_ids(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "WORD_CACHE", 100)
    monkeypatch.setattr(packing, "RUN_BYTES", 2_000)
    monkeypatch.setattr(packing, "WORDS_AT_ONCE", 50)
    texts = _texts()
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])
    for added in (True, False):
        tok = Tokenizer.from_file(tokenizer_path())
        tok.encode_special_tokens = not added
        want = [tok.encode(t or "", add_special_tokens=False).ids + [1] for t in texts]
        parts, got = packing._Parts(tokenizer_path(), added), []
        runs = list(packing.runs_of(batch, 0))
        assert len(runs) > 3 and sum(r.num_rows for r in runs) == len(texts)
        for run in runs:
            ids, starts = parts.encode_all(run.column(0), 1)
            assert ids.dtype == np.dtype("<u4") and starts[-1] == len(ids)
            got += [ids[a:b].tolist() for a, b in zip(starts, starts[1:])]
            assert not any(len(p) > packing.LONG for p in parts)
        assert got == want


def test_unseen_words_of_a_run_are_encoded_together():
    parts = packing._Parts(tokenizer_path(), True)
    real, calls = parts.model, []

    class Counted:
        def encode_batch_fast(self, texts, **kw):
            calls.append(texts)
            return real.encode_batch_fast(texts, **kw)

    parts.model = Counted()
    parts.encode_all(pa.array(["alpha beta, Gamma", "(beta) delta alpha ALPHA", "b\u00eata"]), 1)
    assert [sorted(x.split()) for call in calls for x in call] == [["alpha", "beta", "delta", "gamma"], ["b\u00c3\u00aata"]]


def test_words_that_the_model_s_ends_do_not_tell_apart():
    parts, plain = packing._Parts(tokenizer_path()), packing._Parts(tokenizer_path())
    parts.last[:] = False
    text = pa.array(["some words here", "", "more w\u00f6rds"])
    assert [x.tolist() for x in parts.encode_all(text, 1)] == [x.tolist() for x in plain.encode_all(text, 1)]
