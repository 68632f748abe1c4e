import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from tidefold.llm import pii

from .pii_held_out import lines

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text):
    found = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(part) > 255 for part in m[0].split(".")):
                continue
            if kind == "card" and not (13 <= len(digits) <= 19 and pii.luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            found.append((kind, *m.span()))
    return found


@pytest.fixture(scope="module")
def model():
    return pii.train()


def test_base_spans_equal_the_patterns(documents):
    random.seed(3)
    texts = [r["text"] for r in documents.collect()]
    texts += ["".join(random.choices("a1.@+- ()9b%4/\n²é", k=random.randint(0, 60))) for _ in range(20_000)]
    texts += ["000255.1.2.0003", "1.2.3.4.5.6.7.8", "a@b@c.d", "4111 1111 1111 1111", "x@y.z@w.v"]
    assert all(pii.base_spans(t) == plain(t) for t in texts)


def test_gradient_steps_raise_the_likelihood_and_fit_the_table(model):
    for line in pii.EXAMPLES:
        text, spans = pii.labelled(line)
        assert sorted(pii.added_spans([text], [[]], model)[0]) == sorted(spans), line


def test_viterbi_is_the_best_of_all_paths(model):
    text = "call 555-4827 a@b"
    row = pii._features(text, pii.tokens_of(text))
    ids, gaps, _ = model.padded([row])
    score, move = model.emissions(ids, gaps)[0], model.move + model.allowed
    n = 4
    best = max(
        itertools.product(range(len(pii.LABELS)), repeat=n),
        key=lambda p: model.begin[p[0]] + sum(score[i, l] for i, l in enumerate(p)) + sum(move[a, b] for a, b in zip(p, p[1:])),
    )
    tokens, parted = row
    ids4, gaps4, _ = model.padded([(tokens, parted)])
    short = [np.array(x) for x in model.decode([(tokens, parted)])][0]
    assert len(short) == len(tokens)
    # The first tokens alone, with what stands behind them left out of both.
    cut = (tokens[:n], parted[:n])
    ids, gaps, _ = model.padded([cut])
    score = model.emissions(ids, gaps)[0]
    best = max(
        itertools.product(range(len(pii.LABELS)), repeat=n),
        key=lambda p: model.begin[p[0]] + sum(score[i, l] for i, l in enumerate(p)) + sum(move[a, b] for a, b in zip(p, p[1:])),
    )
    assert tuple(model.decode([cut])[0]) == best


def test_unseen_lines(model):
    unseen = {
        "please phone 415-555-0132 soon": [("phone", "415-555-0132")],
        "mail bob (at) sample.org now": [("email", "bob (at) sample.org")],
        "in chapter 12 of 2019 we saw 3,000 birds": [],
        "released version 4.5.6 on 2020-02-03": [],
        "they met at the. Then at noon": [],
    }
    for text, want in unseen.items():
        base = [pii.base_spans(text)]
        got = base[0] + pii.added_spans([text], base, model)[0]
        assert [(kind, text[a:b]) for kind, a, b in got] == want, text


def test_clean_documents_are_left_alone(documents, model):
    texts = [r["text"] for r in documents.collect()]
    more = [(t[max(0, a - 20) : b + 20], kind) for t, base, added in pii.all_spans(texts, model) for kind, a, b in added]
    assert len(more) <= len(texts) // 100, more


def test_hostile_rows(hostile, no_docs, model):
    rows = pii.find_personal_data(hostile, model).collect()
    assert len(rows) == hostile.count()
    assert all(r["spans"] == "" and r["base_sha256"] == hashlib.sha256(b"").hexdigest() for r in rows)
    masked = pii.mask_personal_data(hostile, model)
    assert masked.columns == hostile.columns
    before = {(r["doc_id"], r["text"]) for r in hostile.collect()}
    assert {(r["doc_id"], r["text"]) for r in masked.collect()} == before
    assert pii.find_personal_data(no_docs, model).count() == 0
    assert pii.mask_personal_data(no_docs, model).count() == 0


def test_very_long_runs(model):
    for text in ("1" * 300_000, "a" * 300_000 + "@", "1.2.3.4 " * 20_000, "+1" * 50_000):
        base = pii.base_spans(text)
        pii.added_spans([text], [base], model)
    assert len(pii.base_spans("1.2.3.4 " * 20_000)) >= 20_000


def test_masking(model):
    text = "to a.b@c.de and +1 (632) 555-4827, é 4111 1111 1111 1111"
    assert pii.masked(text, pii.base_spans(text)) == "to <EMAIL> and <PHONE>, é <CARD>"


def test_spans_without_number_take_linear_time():
    import time

    text = " ".join(f"+49 30 55{i:07}" for i in range(60_000))
    began = time.process_time()
    (found,) = pii.all_spans([text], pii.train())
    assert sum(kind == "phone" for kind, _, _ in found[1]) == 60_000 and time.process_time() - began < 60


def measured(model, kinds):
    """Precision and recall of added spans over the held-out lines, whole spans alone."""
    held = lines()
    texts = [text for text, _ in held]
    base = [pii.base_spans(text) for text in texts]
    added = pii.added_spans(texts, base, model)
    right = wanted = found = 0
    for (text, spans), known, more in zip(held, base, added):
        asked = {s for s in spans if s[0] in kinds and s not in known}
        given = {s for s in more if s[0] in kinds}
        right, wanted, found = right + len(asked & given), wanted + len(asked), found + len(given)
    return right / max(found, 1), right / max(wanted, 1), wanted


def test_held_out_lines(model):
    seen = {pii.labelled(line)[0] for line in pii.EXAMPLES}
    assert len(lines()) >= 75 and not seen & {text for text, _ in lines()}
    precision, recall, wanted = measured(model, pii.KINDS)
    print("held out:", wanted, precision, recall)
    assert wanted > 35 and precision >= 0.8 and recall >= 0.7


def test_written_out_kinds_planted_in_documents(documents, model):
    texts = [r["text"] for r in documents.collect() if r["text"] and 50 < len(r["text"]) < 2_000][:40]
    planted = "reach me: mail tom [at] host [dot] net or my cell is 555 0134 today"
    whole = [f"{text[: len(text) // 2]} {planted} {text[len(text) // 2 :]}" for text in texts]
    base = [pii.base_spans(text) for text in whole]
    hits = 0
    for text, more in zip(whole, pii.added_spans(whole, base, model)):
        shown = {text[a:b] for _, a, b in more}
        hits += ("tom [at] host [dot] net" in shown) + ("555 0134" in shown)
    # 62 of 80 when this was written.
    assert hits >= 1.4 * len(whole)
