"""Secrets: patterns propose candidates, a character convolutional network scores each with its context.

The network is trained here, in numpy, on labelled findings that `labelled_findings` writes from a seed: the tables hold no
labels of secrets. Its scores are calibrated on held-out findings, and the threshold is the highest that keeps the wanted
recall there. Findings of the base patterns always stay; the network decides on the wider candidates.
"""

from __future__ import annotations

import re
import string
from bisect import bisect_left
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.llm.common import merged, per_batch, table

BASE = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
#: Wider candidates: runs of token characters; those with a digit and a letter go to the network.
RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
MIXED = re.compile(r"(?=[^A-Za-z]*[A-Za-z])[^0-9]*[0-9]")

#: Characters of context on either side, and of the candidate in one window; a longer one takes several windows.
AROUND, INSIDE = 24, 48
LENGTH = 2 * AROUND + INSIDE
WIDTH, DIM, FILTERS, HIDDEN = 5, 8, 24, 16
OTHER, PAD = 128, 129
#: Findings to train on, share held out for calibration, least recall there, and the seed of everything.
FINDINGS, HELD_OUT, RECALL, SEED = 4000, 0.25, 0.98, 20240607


def _encode(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le"), "<u4")
    return np.minimum(codes, OTHER).astype(np.uint8)


def windows(text: str, start: int, end: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Character codes and inside marks of the windows over a candidate; together they cover all of it."""
    out = []
    for at in range(start, end, INSIDE):
        lo, hi = at - AROUND, at + INSIDE + AROUND
        codes = np.full(LENGTH, PAD, np.uint8)
        own = _encode(text[max(lo, 0) : hi])
        codes[max(-lo, 0) : max(-lo, 0) + len(own)] = own
        mark = np.zeros(LENGTH, np.float32)
        mark[AROUND : AROUND + min(INSIDE, end - at)] = 1
        out.append((codes, mark))
    return out


class Network:
    """Embedding with an inside mark, one convolution, ReLU, maximum over positions, a hidden layer, one logit."""

    def __init__(self, rng: np.random.Generator):
        n = lambda *shape, s: rng.normal(0, s, shape).astype(np.float32)
        self.p = {"E": n(PAD + 1, DIM, s=0.5), "W": n(WIDTH, DIM + 1, FILTERS, s=0.2), "b": np.zeros(FILTERS, np.float32), "H": n(FILTERS, HIDDEN, s=0.3), "c": np.zeros(HIDDEN, np.float32), "o": n(HIDDEN, s=0.3), "d": np.zeros(1, np.float32)}
        self.scale, self.offset, self.threshold = 1.0, 0.0, 0.5

    def _forward(self, codes: np.ndarray, marks: np.ndarray) -> tuple:
        p = self.p
        x = np.concatenate([p["E"][codes], marks[:, :, None]], axis=2)
        n = LENGTH - WIDTH + 1
        conv = sum(x[:, k : k + n] @ p["W"][k] for k in range(WIDTH)) + p["b"]
        best = conv.argmax(axis=1)
        top = np.maximum(np.take_along_axis(conv, best[:, None, :], axis=1)[:, 0], 0)
        hidden = np.maximum(top @ p["H"] + p["c"], 0)
        return x, best, top, hidden, hidden @ p["o"] + p["d"]

    def logits(self, codes: np.ndarray, marks: np.ndarray) -> np.ndarray:
        return np.concatenate([self._forward(codes[i : i + 512], marks[i : i + 512])[-1] for i in range(0, len(codes), 512)] or [np.zeros(0, np.float32)])

    def train(self, codes: np.ndarray, marks: np.ndarray, y: np.ndarray, rng: np.random.Generator, epochs: int = 6, batch: int = 64, rate: float = 3e-3) -> None:
        """Adam on the logistic loss."""
        p = self.p
        moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in p.items()}
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for i in range(0, len(y), batch):
                rows = order[i : i + batch]
                x, best, top, hidden, z = self._forward(codes[rows], marks[rows])
                dz = (1 / (1 + np.exp(-z)) - y[rows]) / len(rows)
                dh = np.outer(dz, p["o"]) * (hidden > 0)
                dt = dh @ p["H"].T * (top > 0)
                g = {"o": hidden.T @ dz, "d": dz.sum(keepdims=True), "H": top.T @ dh, "c": dh.sum(0), "b": dt.sum(0), "W": np.zeros_like(p["W"]), "E": np.zeros_like(p["E"])}
                r = np.arange(len(rows))[:, None]
                for k in range(WIDTH):
                    at = x[r, best + k]
                    g["W"][k] = np.einsum("nfd,nf->df", at, dt)
                    np.add.at(g["E"], codes[rows][r, best + k], dt[:, :, None] * p["W"][k].T[None, :, :DIM])
                step += 1
                for name, v in p.items():
                    m, s = moments[name]
                    m += 0.1 * (g[name] - m)
                    s += 0.001 * (g[name] ** 2 - s)
                    v -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)).astype(np.float32)

    def calibrate(self, z: np.ndarray, y: np.ndarray, recall: float) -> None:
        """Platt scaling by Newton steps, then the highest threshold with the wanted recall."""
        a, b = 1.0, 0.0
        t = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
        for _ in range(30):
            q = 1 / (1 + np.exp(-(a * z + b)))
            w = q * (1 - q) + 1e-6
            g = np.array([((q - t) * z).sum(), (q - t).sum()])
            h = np.array([[(w * z * z).sum() + 1e-3, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-3]])
            a, b = np.array([a, b]) - np.linalg.solve(h, g)
        self.scale, self.offset = float(a), float(b)
        own = np.sort(self.probability(z[y > 0]))
        self.threshold = float(own[int(np.floor((1 - recall) * len(own)))])

    def probability(self, z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.scale * z.astype(np.float64) + self.offset)))

    def score(self, candidates: list[tuple[str, int, int]]) -> np.ndarray:
        """Probability for each (text, start, end): the largest over its windows."""
        own = [windows(*c) for c in candidates]
        if not own:
            return np.zeros(0)
        codes = np.stack([w[0] for x in own for w in x])
        marks = np.stack([w[1] for x in own for w in x])
        first = np.cumsum([0, *(len(x) for x in own[:-1])])
        return np.maximum.reduceat(self.probability(self.logits(codes, marks)), first)


#: Fixed words of the labelled findings.
NAMES = ("password", "token", "secret", "api_key", "auth", "bearer", "client_secret", "private_key", "access_key", "credential", "session", "signature", "webhook", "pwd")
PLAIN = ("the", "report", "figure", "page", "table", "of", "and", "number", "see", "order", "chapter", "with", "section", "item")
SLUGS = ("annual", "report", "summer", "garden", "photo", "river", "notes", "index", "house", "draft", "winter", "map")


def labelled_findings(n: int, seed: int) -> list[tuple[str, int, int, int]]:
    """text, start, end, label: half are random tokens as services issue them, half ordinary strings of the same shapes."""
    rng = np.random.default_rng(seed)
    pick = lambda x: x[rng.integers(len(x))]
    draw = lambda chars, k: "".join(chars[i] for i in rng.integers(len(chars), size=k))
    some = lambda: " ".join(pick(PLAIN) for _ in range(rng.integers(3, 9)))
    alnum, b64, hexa = string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", "0123456789abcdef"
    out = []
    for i in range(n):
        size = int(rng.integers(20, 65))
        if label := i % 2:
            kind = rng.integers(6)
            body = (draw(alnum, size), draw(b64, size) + "=" * int(rng.integers(3)), draw(alnum, 4).lower() + "_" + draw(alnum, size), pick(("sk-", "pk-", "gh-", "xx-")) + draw(alnum, size), draw(hexa.upper(), size), draw(hexa, size))[kind]
            keyed = (f"{pick(NAMES)}: ", f"{pick(NAMES)}=", f'{pick(NAMES)} = "', f'"{pick(NAMES)}": "', f"export {pick(NAMES).upper()}=", "Authorization: Bearer ")
            lead = pick(keyed if kind == 5 else (*keyed, some() + " "))
        else:
            kind = rng.integers(6)
            body = (
                "-".join(pick(SLUGS) for _ in range(rng.integers(3, 6))) + f"-{rng.integers(1990, 2030)}",
                "/".join(pick(SLUGS) for _ in range(rng.integers(3, 6))) + f"/{rng.integers(100)}",
                "_".join(pick(SLUGS) for _ in range(rng.integers(3, 5))) + f"_v{rng.integers(20)}",
                f"{draw(hexa, 8)}-{draw(hexa, 4)}-{draw(hexa, 4)}-{draw(hexa, 4)}-{draw(hexa, 12)}",
                pick("abcxyz01") * size + draw("0123456789", 1),
                "".join(pick(SLUGS) for _ in range(4)) + draw("0123456789", int(rng.integers(1, 4))),
            )[kind]
            lead = pick((some() + " ", "see https", "file ", "id ", f"{pick(SLUGS)}=", "href="))
        text = f"{some()} {lead}{body}{pick((' ', chr(34), chr(10), '.'))} {some()}"
        start = text.index(lead + body) + len(lead)
        if label and rng.random() < 0.3 and lead in keyed[:3]:  # the base pattern's spans begin at the name
            start -= len(lead)
            body = lead + body
        out.append((text, start, start + len(body), label))
    return out


@lru_cache(maxsize=1)
def trained(findings: int = FINDINGS, recall: float = RECALL, seed: int = SEED) -> Network:
    """The network, the same in every process; a few seconds on the driver."""
    rows = labelled_findings(findings, seed)
    y = np.array([r[3] for r in rows], np.float32)
    own = [windows(*r[:3])[0] for r in rows]
    codes, marks = np.stack([w[0] for w in own]), np.stack([w[1] for w in own])
    rng = np.random.default_rng(seed)
    held = rng.random(len(y)) < HELD_OUT
    net = Network(rng)
    net.train(codes[~held], marks[~held], y[~held], rng)
    net.calibrate(net.logits(codes[held], marks[held]), y[held], recall)
    return net


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the base patterns by start, then kind as listed."""
    found = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[1], BASE.index(x[0])))


def wide_spans(text: str, base: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """Runs of token characters with a digit and a letter that no base span meets."""
    starts, ends = merged([(s, e) for _, s, e in base])
    out = []
    for m in RUN.finditer(text):
        at = bisect_left(ends, m.start() + 1)
        if MIXED.match(m[0]) and not (at < len(starts) and starts[at] < m.end()):
            out.append(m.span())
    return out


def detect(docs: DataFrame) -> DataFrame:
    """doc_id, spans (array of kind, start, end, score) for every row of docs (doc_id, text).

    Base spans, then those of kind `model` that reach the network's threshold, by start. A null or empty text has none.
    Repeated rows and rows without a doc_id stay; other columns aren't read. There is no shuffle.
    """
    net = trained()
    schema = "doc_id long, spans array<struct<kind: string, start: long, end: long, score: double>>"

    def f(batch: pa.RecordBatch) -> dict:
        found, candidates, of = [], [], []
        for i, text in enumerate(batch.column(1).to_pylist()):
            base = base_spans(text) if text else []
            found.append([])
            own = [*base, *(("model", s, e) for s, e in wide_spans(text, base))] if text else []
            for kind, s, e in own:
                candidates.append((text, s, e))
                of.append((i, kind))
        for (i, kind), (_, s, e), p in zip(of, candidates, net.score(candidates).tolist(), strict=True):
            if kind != "model" or p >= net.threshold:
                found[i].append({"kind": kind, "start": s, "end": e, "score": p})
        order = (*BASE, "model")
        return {"doc_id": batch.column(0), "spans": [sorted(x, key=lambda y: (y["start"], order.index(y["kind"]))) for x in found]}

    return per_batch(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), schema, f, 1024)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, digest and list of the spans of every document."""
    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"

    def f(batch: pa.RecordBatch) -> dict:
        found = [[(x["kind"], f"{x['kind']}:{x['start']}:{x['end']}") for x in own] for own in batch.column(1).to_pylist()]
        out = {f"n_{k}": [sum(x[0] == k for x in own) for own in found] for k in BASE}
        return out | {
            "doc_id": batch.column(0),
            "base_sha256": [sha256(",".join(x[1] for x in own if x[0] in BASE).encode()).hexdigest() for own in found],
            "spans": [",".join(x[1] for x in own) for own in found],
        }

    return per_batch(detect(table(spark, sf_dir, "documents")), schema, f)
