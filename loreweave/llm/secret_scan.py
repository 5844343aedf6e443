"""Operator 4: secrets, by pattern and by a small character convolutional network."""

from __future__ import annotations

import bisect
import functools
import random
import re
import string

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_texts

ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex")

#: A candidate is a run of key characters as long as the shortest secret of the base patterns.
CANDIDATE, SHORTEST = re.compile(r"[A-Za-z0-9+/_=~-]{8,}+"), 8
ORDINARY = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+|[-=_~+/]+")
#: Characters that the network sees before, in and after a candidate; a longer one is seen in overlapping parts.
BEFORE, INSIDE, AFTER = 24, 48, 8
PART_STEP = INSIDE // 2
WIDTH = BEFORE + INSIDE + AFTER
CLASSES = 20
#: Training: labelled findings at most, share held out for calibration, recall that the threshold must reach there.
MAX_LABELLED, HELD_OUT, RECALL, SEED = 12000, 0.25, 0.98, 7

Span = tuple[str, int, int]


def detect(text: str) -> list[Span]:
    """The base spans, by start and kind."""
    out = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[1]) >= 8]
    out += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def candidates(text: str) -> list[tuple[int, int]]:
    """Runs that may be secrets; those that base spans cover are among them.  A run that is one word or one number is none."""
    return [m.span() for m in CANDIDATE.finditer(text) if not ORDINARY.fullmatch(m[0])]


def classes() -> np.ndarray:
    """A class for each code point below 128; all others share one, and 0 is the padding."""
    out = np.full(129, CLASSES - 1, np.int64)
    for i, chars in enumerate(("abcdef", "ghijklm", "nopqrst", "uvwxyz", "ABCDEF", "GHIJKLM", "NOPQRST", "UVWXYZ", "01234", "56789", "+/", "_", "-", "=:", "\"'`", ".@", string.whitespace, "()[]{}<>;,")):
        out[[ord(c) for c in chars]] = i + 1
    return out


CLASS_OF = classes()


def parts(span: tuple[int, int]) -> list[tuple[int, int]]:
    """A candidate in parts of at most ``INSIDE`` characters that overlap by half and cover all of it."""
    s, e = span
    return [(at, min(e, at + INSIDE)) for at in range(s, max(s + 1, e - INSIDE + PART_STEP), PART_STEP)]


def windows(text: str, spans: list[tuple[int, int]]) -> np.ndarray:
    """Character classes around and in each span of at most ``INSIDE`` characters, one row a span."""
    out = np.zeros((len(spans), WIDTH), np.int64)
    for row, (s, e) in zip(out, spans):
        inside, before, after = text[s:e], text[max(0, s - BEFORE) : s], text[e : e + AFTER]
        for at, part in ((BEFORE - len(before), before), (BEFORE, inside), (BEFORE + INSIDE, after)):
            row[at : at + len(part)] = CLASS_OF[[min(ord(c), 128) for c in part]]
    return out


class Network:
    """Embedding, one convolution, maximum over the context and over the candidate, one logistic unit."""

    def __init__(self, seed: int = SEED, wide: int = 8, filters: int = 32, width: int = 5):
        r = np.random.default_rng(seed)
        self.p = {
            "embed": r.normal(0, 0.3, (CLASSES, wide)),
            "conv": r.normal(0, 1 / np.sqrt(wide * width), (width * wide, filters)),
            "bias": np.zeros(filters),
            "out": r.normal(0, 0.1, 2 * filters),
            "base": np.zeros(1),
        }
        self.width, self.slope, self.shift, self.threshold = width, 1.0, 0.0, 0.5

    def forward(self, x: np.ndarray):
        e = self.p["embed"][x]
        n = WIDTH - self.width + 1
        cols = np.concatenate([e[:, i : i + n] for i in range(self.width)], axis=2)
        a = np.maximum(cols @ self.p["conv"] + self.p["bias"], 0)
        inner = slice(BEFORE, BEFORE + INSIDE)
        near, within = a.copy(), a[:, inner]
        near[:, inner] = -1
        at = near.argmax(1), within.argmax(1) + BEFORE
        pooled = np.concatenate([np.take_along_axis(a, k[:, None], 1)[:, 0] for k in at], axis=1)
        return pooled @ self.p["out"] + self.p["base"][0], (cols, pooled, at)

    def fit(self, x: np.ndarray, y: np.ndarray, rounds: int = 16, step: float = 0.008) -> None:
        """Adam on the logistic loss; the held-out part then sets the calibration and the threshold."""
        r = np.random.default_rng(SEED)
        order = r.permutation(len(x))
        cut = int(len(x) * HELD_OUT)
        held, train = order[:cut], order[cut:]
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(w) for k, w in self.p.items()}
        t = 0
        for _ in range(rounds):
            r.shuffle(train)
            for at in range(0, len(train), 128):
                rows = train[at : at + 128]
                z, (cols, pooled, picks) = self.forward(x[rows])
                d = (1 / (1 + np.exp(-z)) - y[rows]) / len(rows)
                g = {"out": pooled.T @ d, "base": np.array([d.sum()])}
                dp = np.outer(d, self.p["out"]) * (pooled > 0)
                f = dp.shape[1] // 2
                g["conv"], g["bias"], g["embed"] = np.zeros_like(self.p["conv"]), np.zeros(f), np.zeros_like(self.p["embed"])
                wide = self.p["embed"].shape[1]
                for part, pick in enumerate(picks):
                    dq = dp[:, part * f : (part + 1) * f]
                    got = cols[np.arange(len(rows))[:, None], pick]
                    g["conv"] += np.einsum("bf,bfc->cf", dq, got)
                    g["bias"] += dq.sum(0)
                    back = np.einsum("bf,cf->bfc", dq, self.p["conv"]).reshape(len(rows), f, self.width, wide)
                    np.add.at(g["embed"], x[rows][np.arange(len(rows))[:, None, None], pick[:, :, None] + np.arange(self.width)], back)
                t += 1
                for k in self.p:
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                    self.p[k] -= step * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        z, truth = self.forward(x[held])[0], y[held]
        for _ in range(200):  # Platt's calibration
            q = 1 / (1 + np.exp(-(self.slope * z + self.shift)))
            self.slope -= 0.5 * float(np.mean((q - truth) * z)) / max(1.0, float(np.mean(z * z)))
            self.shift -= 0.5 * float(np.mean(q - truth))
        true = np.sort(self.score_of(z[truth == 1]))
        loses = int((1 - RECALL) * len(true))
        self.threshold = float(true[loses]) if len(true) else 0.5  # the highest one that keeps the recall

    def score_of(self, z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * z + self.shift)))

    def score_spans(self, texts: list[str], spans: list[list[tuple[int, int]]]) -> list[list[float]]:
        """The score of each candidate of each text: the highest of its parts."""
        cut = [[parts(span) for span in own] for own in spans]
        shapes = [windows(t, [p for ps in own for p in ps]) for t, own in zip(texts, cut) if own]
        flat = self.score(np.concatenate(shapes)) if shapes else np.zeros(0)
        sizes = [len(ps) for own in cut for ps in own]
        best = iter(np.maximum.reduceat(flat, np.cumsum([0, *sizes[:-1]])).tolist() if sizes else [])
        return [[next(best) for _ in own] for own in cut]

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self.score_of(self.forward(x[i : i + 512])[0]) for i in range(0, len(x), 512)]) if len(x) else np.zeros(0)


def labelled_findings(n: int = MAX_LABELLED, seed: int = SEED) -> list[tuple[str, int, int, int]]:
    """(text, start, end, label): keys in settings and code, and long runs that are none, made by rule."""
    r = random.Random(seed)
    low, up, num = string.ascii_lowercase, string.ascii_uppercase, string.digits
    some = lambda chars, a, b: "".join(r.choice(chars) for _ in range(r.randint(a, b)))
    word = lambda: some(low, 2, 9)
    secret = [
        lambda: some(low[:6] + num, 32, 64),
        lambda: some(low + up + num, 24, 64),
        lambda: some(low + up + num + "+/", 28, 88) + "=" * r.randint(0, 2),
        lambda: r.choice(["ghp_", "sk-", "xoxb-", "glpat-", "AIza", "sk_live_"]) + some(low + up + num, 24, 48),
        lambda: "AKIA" + some(up + num, 16, 20),
        lambda: "eyJ" + some(low + up + num + "-_", 40, 90),
        lambda: some(low + up + num, 12, 22),
        lambda: some(low + up + num, 12, 22),
        lambda: some("ABCDEF" + num, 32, 64),
        lambda: r.choice(["xoxb-", "xapp-"]) + "-".join(some(num, 9, 12) for _ in range(2)) + "-" + some(low + up + num, 24, 32),
        lambda: "/".join([word() for _ in range(r.randint(2, 5))]) + "/key=" + r.choice(["ghp_", "sk-", ""]) + some(low + up + num, 28, 40) + "/" + word(),
    ]
    plain = [
        lambda: "-".join([word() for _ in range(4)] + [str(r.randint(1, 2030))]) + word(),
        lambda: "_".join([word() for _ in range(3)]) + "_v" + str(r.randint(1, 99)) + word() * 2,
        lambda: "/".join([word() for _ in range(4)]) + "/" + str(r.randint(1, 3000)) + "/" + word() + word(),
        lambda: f"20{r.randint(10, 30)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}-{word()}-{word()}-{word()}",
        lambda: word() + word() + word() + str(r.randint(1, 9)) + word(),
        lambda: "=" * r.randint(18, 40) + word() + str(r.randint(1, 9)),
        lambda: "-".join(some(low[:6] + num, k, k) for k in (8, 4, 4, 4, 12)),
        lambda: word() + str(r.randint(1, 99999)) + r.choice(["", word()]),
        lambda: str(r.randint(1, 9999)) + r.choice(["-", "", "_"]) + word(),
        lambda: some(num, 4, 12) + r.choice(["-", "/", ""]) + some(num, 2, 8) + r.choice(low + up),
        lambda: word().capitalize() + "-" + word() + "-" + str(r.randint(1, 2030)),
        lambda: "/".join([word() for _ in range(r.randint(3, 12))]) + "/" + str(r.randint(1, 99)),
        lambda: "-".join([word() for _ in range(r.randint(2, 5))]),
        lambda: some(up, 2, 2) + some(num, 14, 24),  # accounts
        lambda: some(up, 2, 2) + some(num, 2, 2) + some(up, 4, 4) + some(num, 10, 18),
        lambda: some("ABCDEFGHJKLMNPRSTUVWXYZ" + num, 17, 17),  # vehicles
        lambda: some("ABCDEFGHJKLMNPRSTUVWXYZ" + num, 9, 11) + some(num, 6, 6),
        lambda: r.choice(["DSC", "P", "GOPR", "MVI_", "PXL_", "IMG_", "VID_"]) + some(num, 4, 8) + r.choice(["", "_" + some(num, 6, 9)]),
        lambda: f"{word()}_{some(num, 8, 8)}_{some(num, 6, 6)}",
        lambda: f"v{r.randint(0, 9)}-{r.randint(1, 99)}-g" + some(low[:6] + num, 7, 10),
        lambda: "-".join(some(num, 1, 5) for _ in range(5)),
        lambda: some(up, 2, 5) + "-" + some(num, 3, 6) + "-" + some(up + num, 1, 4),
    ]
    # what these are is only told by what stands before them
    told = [
        lambda: (r.choice(["data:image/jpeg;base64,", "data:image/gif;base64,", "url(data:image/webp;base64,", "data:font/woff;base64,", "Content-Transfer-Encoding: base64\n\n"]), some(low + up + num + "+/", 60, 400)),
        lambda: (r.choice(["watch?v=", "youtu.be/", "video ", "/v/", "videoid: "]), some(low + up + num + "-_", 11, 11)),
        lambda: (r.choice(["commit ", "at revision ", "sha1 ", "checksum: ", "integrity sha512-"]), some(low + up + num + "+/", 40, 88)),
        lambda: (r.choice(["IBAN: ", "account ", "VIN ", "chassis no. ", "order no. ", "ISBN "]), some(up + num, 12, 24)),
    ]
    names = ["token", "key", "secret", "auth", "Authorization: Bearer", "credential", "access_key", "private_key", "client_secret", "pwd"]
    out = []
    for i in range(n):
        label = i % 2
        before, run = ("", r.choice(secret)()) if label else r.choice(told)() if r.random() < 0.25 else ("", r.choice(plain)())
        if len(run) < SHORTEST:
            run += "-" + some(low, SHORTEST, SHORTEST + 4)
        said = label if r.random() < 0.8 else 1 - label  # the name before it is a hint and no more
        left = f"{r.choice(names)}{r.choice([' = ', '=', ': ', ' '])}{r.choice(['', chr(34), chr(39)])}" if said else " ".join([word() for _ in range(r.randint(0, 4))]) + " "
        left = " ".join([word() for _ in range(r.randint(0, 4))]) + " " + (before or left)
        text = left + run + r.choice([" ", '"', ".\n", ", "]) + word()
        out.append((text, len(left), len(left) + len(run), label))
    return out


def train(findings: list[tuple[str, int, int, int]] | None = None) -> Network:
    """A network from labelled findings, at most ``MAX_LABELLED`` of them; a few seconds of numpy."""
    findings = (findings or labelled_findings())[:MAX_LABELLED]
    # of a plain run every part is plain; of a secret one of its first parts, that with most kinds of characters, stands for it
    kinds = lambda t, p: len({CLASS_OF[min(ord(c), 128)] for c in t[p[0] : p[1]]})
    rows = [(t, p, y) for t, s, e, y in findings for p in ([max(parts((s, e))[:3], key=lambda p: kinds(t, p))] if y else parts((s, e)))]
    net = Network()
    net.fit(np.concatenate([windows(t, [p]) for t, p, _ in rows]), np.array([y for *_, y in rows], float))
    return net


@functools.cache
def trained() -> Network:
    """The network of the findings made by rule, trained once a process."""
    return train()


def find_secrets(df: DataFrame, text_col: str = "text", network: Network | None = None, drop: tuple[str, ...] = ()) -> DataFrame:
    """Add ``secrets``: an array of (kind, start, end, score), by start and then kind.

    Every candidate is scored over its whole length.  Base findings have a null
    score where no candidate touches them; a candidate that touches no base span is
    added with kind ``model`` if its calibrated score reaches the network's threshold,
    the highest that keeps ``RECALL`` of the findings held out in training.  The network is trained on the driver
    from a bounded set and sent to the workers (a few kilobytes).  Offsets count
    code points, ends are exclusive.  A null or empty text has an empty array.
    Other columns and repeated rows stay, an empty table gives an empty one, and a
    column named ``secrets`` is replaced.  Nothing is shuffled.
    """
    net = network or trained()
    item = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])

    def run(texts: list[str]) -> list[pa.Array]:
        base = [detect(t) for t in texts]
        runs = [candidates(t) for t in texts]
        rows = []
        for spans, own, scores in zip(base, runs, net.score_spans(texts, runs)):
            out, begins, ends = [], [s for s, _ in own], [e for _, e in own]
            free = np.ones(len(own), bool)
            for k, s, e in spans:  # candidates are apart and in order, so those that a span touches are a range
                lo, hi = bisect.bisect_right(ends, s), bisect.bisect_left(begins, e)
                free[lo:hi] = False
                out.append((k, s, e, max(scores[lo:hi], default=None)))
            out += [("model", s, e, p) for (s, e), p, f in zip(own, scores, free.tolist()) if f and p >= net.threshold]
            out.sort(key=lambda f: (f[1], (*KINDS, "model").index(f[0])))
            rows.append([dict(zip(("kind", "start", "end", "score"), f)) for f in out])
        return [pa.array(rows, pa.list_(item))]

    return map_texts(df, run, "secrets array<struct<kind:string,start:int,end:int,score:double>>", text_col, drop)
