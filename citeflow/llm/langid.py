"""Language identification by a bidirectional gated recurrent network over bytes.

The network is trained in numpy by backpropagation through time on a bounded sample of labelled rows.
Every byte of every text is a position with its own label distribution; a document's probabilities pool
those of all its positions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What letters are among; numerals and such are told apart by ``has_letter``.
_WORDS = re.compile(r"[^\W\d_]+")
#: Byte that fills windows up; its positions carry no label. In a text it reads as a blank.
PAD = 0
#: The label of what is in none of the learned languages; no language's name sorts after it.
NONE = "\U0010ffff"
#: The share of the languages' training windows taken for noise from which on a network rejects nothing.
MISTAKEN = 0.02


@dataclass(frozen=True)
class Training:
    """Bounds and settings of the fit. At most ``per_label`` rows of each label and about ``rows`` in all
    are read, with ``windows`` windows of ``window`` bytes from each; labels and predictions have no bound."""

    per_label: int = 500
    rows: int = 32_000
    windows: int = 3
    window: int = 64
    hidden: int = 8
    steps: int = 300
    batch: int = 128
    rate: float = 0.03
    seed: int = 3


def has_letter(text: str) -> bool:
    """Whether the text has a letter (of Unicode's category L)."""
    return any(any(map(str.isalpha, m[0])) for m in _WORDS.finditer(text))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In place, by the hyperbolic tangent, which does not overflow."""
    x *= 0.5
    np.tanh(x, out=x)
    x += 1.0
    x *= 0.5
    return x


class BiGru:
    """Gates z and r, candidate c: h' = z h + (1 - z) tanh(c); a softmax over both directions' states.

    ``scale`` is how many independent positions the mean position of a text counts for; ``rejects`` says
    whether the network has learned to tell languages from noise."""

    def __init__(self, params: dict[str, np.ndarray], labels: list[str], scale: float = 1.0, rejects: bool = False):
        self.p, self.labels, self.scale, self.rejects = params, labels, scale, rejects

    @staticmethod
    def fresh(labels: list[str], hidden: int, seed: int) -> BiGru:
        rng = np.random.default_rng(seed)

        def draw(rows: int, cols: int, scale: float) -> np.ndarray:
            return (rng.standard_normal((rows, cols)) * scale).astype(np.float32)

        p = {}
        for d in "fb":
            p[f"x{d}"] = draw(3 * hidden, 256, 0.3)
            p[f"x{d}"][:hidden] += 1.0
            p[f"g{d}"] = draw(2 * hidden, hidden, hidden**-0.5)
            p[f"c{d}"] = draw(hidden, hidden, hidden**-0.5)
            p[f"o{d}"] = draw(len(labels), hidden, 0.3)
        p["bias"] = np.zeros((len(labels), 1), np.float32)
        return BiGru(p, labels)

    def _run(self, x: np.ndarray, d: str, logits: np.ndarray, tape: list | None = None) -> None:
        """Add one direction's logits over ``x`` (time, batch) to ``logits`` (time, label, batch)."""
        table, gates, cand, top = (self.p[f"{k}{d}"] for k in "xgco")
        hidden = len(cand)
        h = np.zeros((hidden, x.shape[1]), table.dtype)
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            a = np.take(table, x[t], axis=1, mode="clip")
            zr = a[: 2 * hidden]
            zr += gates @ h
            _sigmoid(zr)
            z, r = zr[:hidden], zr[hidden:]
            rh = r * h
            c = a[2 * hidden :]
            c += cand @ rh
            np.tanh(c, out=c)
            if tape is not None:
                tape.append((t, h, z, r, rh, c))
            h = h - c
            h *= z
            h += c
            logits[t] += top @ h

    def position_logits(self, x: np.ndarray, tapes: tuple[list, list] | None = None) -> np.ndarray:
        logits = np.zeros((x.shape[0], len(self.labels), x.shape[1]), self.p["bias"].dtype)
        logits += self.p["bias"]
        for i, d in enumerate("fb"):
            self._run(x, d, logits, tapes and tapes[i])
        return logits

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over positions and its gradients, by backpropagation through time."""
        tapes: tuple[list, list] = ([], [])
        logits = self.position_logits(x, tapes)
        prob = np.exp(logits - logits.max(axis=1, keepdims=True))
        prob /= prob.sum(axis=1, keepdims=True)
        real = (x != PAD)[:, None, :].astype(np.float32)
        count = max(1.0, float(real.sum()))
        cols = np.arange(x.shape[1])
        loss = float(-(np.log(np.maximum(prob[:, y, cols], 1e-30)) * real[:, 0]).sum() / count)
        delta = prob
        delta[:, y, cols] -= 1
        delta *= real / delta.dtype.type(count)
        g = {"bias": delta.sum((0, 2))[:, None]}
        for i, d in enumerate("fb"):
            gates, cand, top = (self.p[f"{k}{d}"] for k in "gco")
            hidden = len(cand)
            gg, gc, go = np.zeros_like(gates), np.zeros_like(cand), np.zeros_like(top)
            inner = np.empty((len(x), 3 * hidden, x.shape[1]), top.dtype)
            dh = np.zeros((hidden, x.shape[1]), top.dtype)
            for t, h, z, r, rh, c in reversed(tapes[i]):
                go += delta[t] @ (c + z * (h - c)).T
                dh = dh + top.T @ delta[t]
                dc = dh * (1 - z) * (1 - c * c)
                drh = cand.T @ dc
                inner[t, :hidden] = dh * (h - c) * z * (1 - z)
                inner[t, hidden : 2 * hidden] = drh * h * r * (1 - r)
                inner[t, 2 * hidden :] = dc
                dzr = inner[t, : 2 * hidden]
                gc += dc @ rh.T
                gg += dzr @ h.T
                dh = dh * z + drh * r + gates.T @ dzr
            flat = x.ravel()
            gx = np.stack([np.bincount(flat, inner[:, k].ravel(), 256) for k in range(3 * hidden)])
            g |= {f"x{d}": gx, f"g{d}": gg, f"c{d}": gc, f"o{d}": go}
        return loss, g

    def mean_logs(self, windows: np.ndarray, owner: np.ndarray, n: int, at_once: int = 4096) -> np.ndarray:
        """Mean log-probability of each label over all positions of each of ``n`` texts, to whom (windows,
        time) byte windows belong."""
        logs, seen = np.zeros((n, len(self.labels))), np.zeros(n)
        for at in range(0, len(windows), at_once):
            x = np.ascontiguousarray(windows[at : at + at_once].T)
            logits = self.position_logits(x)
            logits -= logits.max(axis=1, keepdims=True)
            total = np.exp(logits).sum(axis=1)
            real = (x != PAD).astype(np.float32)
            pooled = np.zeros((len(self.labels), x.shape[1]), np.float32)
            for t in range(len(x)):
                pooled += (logits[t] - np.log(total[t])) * real[t]
            np.add.at(logs, owner[at : at + at_once], pooled.T)
            np.add.at(seen, owner[at : at + at_once], real.sum(axis=0))
        return logs / np.maximum(seen, 1)[:, None]

    def document_probabilities(self, windows: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        """Softmax of each text's mean log-probabilities, times ``scale``."""
        return softmax(self.scale * self.mean_logs(windows, owner, n))

    def calibrate(self, windows: np.ndarray, labels: np.ndarray) -> None:
        """Set ``scale`` to what makes the labels of some windows, each taken for a text, most probable, and
        ``rejects`` if hardly any of a language's windows is taken for noise."""
        means = self.mean_logs(windows, np.arange(len(windows)), len(windows))
        loss = {s: -np.log(np.maximum(softmax(s * means)[np.arange(len(labels)), labels], 1e-30)).mean() for s in 2.0 ** np.arange(-2, 7, 0.5)}
        self.scale = float(min(loss, key=loss.get))
        none = self.labels.index(NONE)
        self.rejects = bool((means[labels != none].argmax(axis=1) == none).mean() < MISTAKEN)


def softmax(x: np.ndarray) -> np.ndarray:
    prob = np.exp(x - x.max(axis=1, keepdims=True))
    return prob / prob.sum(axis=1, keepdims=True)


def noise(n: int, seed: int) -> list[str]:
    """Texts in no language, of equal parts letters, hexadecimal digits, printable characters and letters of
    some stretch of Unicode, each drawn at random. Labelled languages of other scripts outweigh them in training."""
    rng = np.random.default_rng(seed)
    hexadecimal = np.frombuffer(b"0123456789abcdef", np.uint8)

    def word(kind: int) -> str:
        size = int(rng.integers(2, 12))
        if kind == 3:
            codes = rng.integers(0x250, 0xD700) + rng.integers(0, 60, size)
        else:
            codes = (rng.integers(97, 123, size), hexadecimal[rng.integers(0, 16, size)], rng.integers(33, 127, size))[kind]
        return "".join(map(chr, codes))

    return [" ".join(word(i % 4) for _ in range(30)) for i in range(n)]


def byte_windows(texts: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of all texts in windows of ``window`` bytes, with each window's text."""
    counts = np.array([-(-len(t) // window) for t in texts], np.int64)
    out = np.zeros((int(counts.sum()), window), np.uint8)
    flat, at = out.reshape(-1), 0
    for t, c in zip(texts, counts, strict=True):
        flat[at : at + len(t)] = np.frombuffer(t.replace(b"\0", b" "), np.uint8)
        at += int(c) * window
    return out, np.repeat(np.arange(len(texts)), counts)


def train(texts: list[bytes], labels: list[str], how: Training) -> BiGru:
    """Fit by Adam on windows drawn evenly over labels and over as much noise, whose label is NONE."""
    extra = noise(how.per_label, how.seed)
    texts, labels = texts + [t.encode() for t in extra], labels + [NONE] * len(extra)
    names = sorted(set(labels))
    net = BiGru.fresh(names, how.hidden, how.seed)
    rng = np.random.default_rng(how.seed)
    by_label: list[list[np.ndarray]] = [[] for _ in names]
    for text, label in zip(texts, labels, strict=True):
        raw = np.frombuffer(text.replace(b"\0", b" "), np.uint8)
        for start in rng.integers(0, max(1, len(raw) - how.window + 1), how.windows):
            piece = raw[start : start + how.window]
            if len(piece):
                by_label[names.index(label)].append(np.pad(piece, (0, how.window - len(piece))))
    kept = np.array([i for i, x in enumerate(by_label) if x])
    if len(kept) < 2:
        return net
    pool = np.stack([piece for pieces in by_label for piece in pieces])
    sizes = np.array([len(by_label[i]) for i in kept])
    first = np.cumsum(sizes) - sizes
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    for step in range(1, how.steps + 1):
        which = rng.integers(0, len(kept), how.batch)
        x = pool[first[which] + rng.integers(0, sizes[which])].T
        _, g = net.gradients(np.ascontiguousarray(x), kept[which])
        norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
        rate = how.rate * min(1.0, 1.5 * (1 - (step - 1) / how.steps)) * min(1.0, 1.0 / max(norm, 1e-9))
        for k, v in g.items():
            m, s = moment[k]
            m += 0.1 * (v - m)
            s += 0.01 * (v * v - s)
            net.p[k] -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
    net.calibrate(pool, np.repeat(kept, sizes))
    return net


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def training_rows(docs: DataFrame, how: Training, *, id_col: str, text_col: str, lang_col: str) -> list:
    """The bounded sample, by hash of the id: at most twice ``per_label`` rows a label are collected."""
    usable = docs.where(~held_out(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    # A row a label, and so no more than there are languages.
    counts = usable.groupBy(lang_col).count().orderBy(lang_col).collect()
    if not counts:
        return []
    each = max(1, min(how.per_label, how.rows // len(counts)))
    bar = None
    for lang, n in counts:
        level = min(1.0, 1.2 * each / n)
        bar = (F.when if bar is None else bar.when)(F.col(lang_col) == lang, F.lit(level))
    share = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit(how.seed)), F.lit(1 << 20)) / float(1 << 20)
    span = F.lit(how.windows * how.window * 4)
    start = F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.greatest(F.lit(1), F.length(text_col) - span)) + 1
    rows = usable.where(share < bar.otherwise(0.0)).select(F.col(id_col).cast("string").alias("id"), F.col(lang_col).alias("lang"), F.substring(F.col(text_col), start.cast("int"), span).alias("text"))
    rows = rows.orderBy(F.xxhash64("id"), "id", "text").limit(2 * each * len(counts)).collect()
    taken: dict[str, int] = {}
    return [r for r in rows if taken.setdefault(r.lang, 0) < each and not taken.update({r.lang: taken[r.lang] + 1})]


def identify_languages(
    docs: DataFrame,
    *,
    how: Training | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
) -> DataFrame:
    """One row per input row: id, ``held_out``, ``lang_pred``, ``score``.

    Fitted on labelled rows that are not held out (crc32 of the id as text, modulo 4, is not 2; null
    ids are not held out). ``lang_pred`` is a learned label, ``und`` with score 0 if the text is null or
    has no letter, or if no row is labelled; ``score`` is the pooled probability, in which what is in no
    language has its share, on a scale fitted to the training windows. Whole texts are read, in windows. Repeated rows get equal answers; other columns are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    label = _labeller(docs, how or Training(), id_col=id_col, text_col=text_col, lang_col=lang_col)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, names, scores, _ in label(batches, 2):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names), pa.array(scores, pa.float64())], names=[id_col, "held_out", "lang_pred", "score"])

    given = docs.select(id_col, held_out(id_col).alias("held_out"), text_col)
    return given.mapInArrow(predict, f"{id_col} {kind}, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, *, how: Training | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``docs`` that the network takes for one of its languages, all columns kept.

    Documents go whose text is null or has no letter, and those whose positions the network gives to no
    language rather than to the best one (if the network can tell its own training windows from noise).
    Unlike labels are not held against a document. Where no row is
    labelled, documents go by their letters alone. Repeated rows and null ids stay as they are; an empty
    table stays empty; extra columns of any name and type are kept.
    """
    label = _labeller(docs, how or Training(), id_col=id_col, text_col=text_col, lang_col=lang_col)
    at = docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, names, scores, none in label(batches, at):
            if label.labels:
                good = [n != "und" and s >= x for n, s, x in zip(names, scores, none, strict=True)]
            else:
                good = [bool(t) and has_letter(t) for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def _labeller(docs: DataFrame, how: Training, *, id_col: str, text_col: str, lang_col: str):
    """Fit on ``docs`` and return a function from batches to (batch, labels, scores, NONE's scores)."""
    rows = training_rows(docs, how, id_col=id_col, text_col=text_col, lang_col=lang_col)
    net = train([r.text.encode() for r in rows], [r.lang for r in rows], how) if rows else BiGru({}, [])
    sent = docs.sparkSession.sparkContext.broadcast((net.p, net.labels, net.scale, net.rejects))

    def label(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[str], list[float], list[float]]]:
        model = BiGru(*sent.value)
        for whole in batches:
            for at in range(0, max(1, whole.num_rows), 256):
                batch = whole.slice(at, 256)
                texts = batch.column(column).to_pylist()
                known = [i for i, t in enumerate(texts) if t and model.labels and has_letter(t)]
                names, scores, none = ["und"] * len(texts), [0.0] * len(texts), [1.0] * len(texts)
                windows, owner = byte_windows([texts[i].encode() for i in known], how.window)
                prob = model.document_probabilities(windows, owner, len(known)) if known else None
                for row, i in enumerate(known):
                    best = int(prob[row, :-1].argmax())  # NONE is the last label
                    names[i], scores[i], none[i] = model.labels[best], float(prob[row, best]), float(prob[row, -1]) if model.rejects else 0.0
                yield batch, names, scores, none

    label.labels = net.labels
    return label
