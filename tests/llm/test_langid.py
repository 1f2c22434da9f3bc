from __future__ import annotations

import random
import zlib

import numpy as np

from bulwark.llm import langid

SYLLABLES = {"aa": "ka lo mi ta ru", "bb": "schu gel ver ung bach", "cc": "tion ment eau oux ais"}


def texts(n, seed=1):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        lang = rng.choice([*SYLLABLES])
        parts = SYLLABLES[lang].split()
        out.append((k, " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(3, 80))), lang, "s"))
    return out


def test_held_out_accuracy(docs):
    rows = texts(600)
    got = {r.doc_id: r for r in langid.identify(docs(rows)).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 == 1]
    assert all(got[r[0]].held_out == (zlib.crc32(str(r[0]).encode()) % 3 == 1) for r in rows)
    assert np.mean([got[r[0]].lang_pred == r[2] for r in held]) > 0.98
    assert all(0 <= r.score <= 1 for r in got.values())


def test_labels_of_held_out_rows_are_not_learned(docs):
    rows = [(i, t, "zz" if zlib.crc32(str(i).encode()) % 3 == 1 else g, s) for i, t, g, s in texts(200)]
    assert "zz" not in {r.lang_pred for r in langid.identify(docs(rows)).collect()}


def test_edges(docs, edge_rows):
    got = langid.identify(docs([*edge_rows, (30, "1234 !!", "en", "s")])).collect()
    assert len(got) == len(edge_rows) + 1
    assert {r.lang_pred for r in got if r.doc_id in (2, 3, 30)} == {"und"}
    assert langid.identify(docs([])).count() == 0
    assert {r.lang_pred for r in langid.identify(docs([(i, t, None, s) for i, t, _, s in texts(20)])).collect()} == {"und"}


def test_training_is_sparse_and_calibrated():
    rows = texts(300, 4)
    counts = [np.unique(langid.buckets(t), return_counts=True) for _, t, _, _ in rows]
    model = langid.train([(a, n.astype(float)) for a, n in counts], [r[2] for r in rows])
    assert (model.weights == 0).mean() > 0.5 and 0.05 <= model.temperature <= 20
    assert abs(sum(langid.softmax(model.logits(rows[0][1]))) - 1) < 1e-9
