"""The pipeline's first stage: the network decides, by all positions of each text."""

import random
from collections import Counter

import numpy as np

from citeflow.llm import langid

SCHEMA = "doc_id long, text string, lang string, extra map<string,int>"
WORDS = {"en": "the of and to in that is was he for it with as his on be at by had not are but from".split(), "de": "der die und das ist nicht ein eine zu den mit von sich auf für auch werden wird über".split()}
FOREIGN = ["日本語の文章はここにあります。今日は天気がいいです。", "Это русский текст о погоде и новостях дня.", "Αυτό είναι ένα ελληνικό κείμενο.", "מזג האוויר היום נעים מאוד", "هذا نص عن الطقس", "สวัสดีชาวโลกวันนี้อากาศดี"]
MASH = ["9f8a7b6c5d4e3f2a1b0c9d8e7f6a5b4c0d1e2f", "asdkjh qwlkejh zxmcnb qpwoeiru ghfjdk mznxbcv", "xkcdqz wvbnmk lpoqzz vvwxyz kjhqwx", "k#9$ zz@! 0x88ff {}[] ^^~ q1w2e3r4"]


def rows():
    rng = random.Random(1)
    out = [(i, " ".join(rng.choices(WORDS[lang], k=rng.choice([5, 40, 300]))), None if i % 5 == 0 else lang, {"n": i}) for i in range(200) for lang in [("en", "de")[i % 2]]]
    odd = FOREIGN + MASH + [None, "", "12 !?"]
    return out + [(1000 + i, t, None, {}) for i, t in enumerate(odd)]


def plain(net, text, window):
    """Mean log-probabilities by reading each window of the text position by position."""
    raw, logs = text.encode().replace(b"\0", b" "), []
    for at in range(0, len(raw), window):
        piece = np.frombuffer(raw[at : at + window].ljust(window, b"\0"), np.uint8)
        logit = np.tile(net.p["bias"][:, 0].astype(np.float64), (window, 1))
        for d in "fb":
            hidden = len(net.p[f"c{d}"])
            h = np.zeros(hidden)
            for t in range(window) if d == "f" else range(window - 1, -1, -1):
                given = net.p[f"x{d}"][:, piece[t]].astype(np.float64)
                z, r = np.split(1 / (1 + np.exp(-(given[: 2 * hidden] + net.p[f"g{d}"] @ h))), 2)
                h = z * h + (1 - z) * np.tanh(given[2 * hidden :] + net.p[f"c{d}"] @ (r * h))
                logit[t] += net.p[f"o{d}"] @ h
        logs += list((logit - np.log(np.exp(logit).sum(1, keepdims=True)))[: len(raw) - at])
    return np.mean(logs, axis=0)


def test_the_network_rejects(spark):
    given = rows()
    docs = spark.createDataFrame(given, SCHEMA).repartition(3)
    how = langid.Training(steps=200)
    held = langid.training_rows(docs, how, id_col="doc_id", text_col="text", lang_col="lang")
    net = langid.train([r.text.encode() for r in held], [r.lang for r in held], how)
    assert net.labels[-1] == langid.NONE and set(net.labels[:-1]) == {"de", "en"}
    want = []
    for doc_id, text, _, _ in given:
        if text and any(map(str.isalpha, text)):
            mean = plain(net, text, how.window)
            if mean[:-1].max() >= mean[-1]:
                want.append((doc_id, text))
    kept = langid.keep_identified(docs, how=how)
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter(want)
    ids = {i for i, _ in want}
    assert kept.columns == docs.columns and len(ids & set(range(200))) >= 198
    assert not ids & set(range(1000 + len(FOREIGN), 1013)) and len(ids & set(range(1000, 1000 + len(FOREIGN)))) <= 1


def test_scores_are_probabilities(spark):
    docs = spark.createDataFrame(rows(), SCHEMA).repartition(3)
    found = {r.doc_id: r for r in langid.identify_languages(docs, how=langid.Training(steps=200)).collect()}
    assert np.mean([found[i].lang_pred == ("en", "de")[i % 2] for i in range(200)]) > 0.97
    assert np.mean([found[i].score for i in range(200)]) > 0.8
    assert max(found[i].score for i in range(1006, 1010)) < 0.5
    assert {found[i].lang_pred for i in range(1000, 1010)} <= {"en", "de"} and {found[i].lang_pred for i in range(1010, 1013)} == {"und"}
