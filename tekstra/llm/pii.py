"""Personal data: exact patterns, and a character-level bidirectional LSTM with CRF transitions.

The tagger is trained here, in numpy, from labelled spans: sentences made by a seeded generator, with
personal data and look-alikes of many forms put in and labelled. Its tags are begin and inside of each
kind, and outside. Each whole text is cut into overlapping windows, the network runs over many windows
at once, each character takes its scores from the window in which it lies most centrally, and one
Viterbi pass over the whole text reconciles the windows.

The patterns' spans stand. The tagger adds spans that overlap none of them, whose characters it is
sure of, and that pass a plain check of their kind.

The plain check bounds the CRF: a character that no span passing it can hold may only be outside. So
the windows that own none of the other characters can't change a result, and ``scanned`` leaves them out;
``tagged`` without ``where`` runs them all.
"""

from __future__ import annotations

import functools
import itertools
import random
import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import claim, map_batches, utf8

KINDS = ("email", "ip", "card", "phone")
TAGS = 1 + 2 * len(KINDS)
#: Window length; how far windows shift.
WINDOW, SHIFT = 128, 64
#: Characters that are decoded as one block, and that a block's run-up takes; neither changes results.
BLOCK, RUN_UP = 256, 64
#: Least mean probability of a span's characters.
SURE = 0.9

# Patterns of the base scan. Each is linear in the text.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_NUMBERS = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for at, d in enumerate(reversed(digits)):
        d = int(d) * (1 + at % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def small_parts(ip: str) -> bool:
    return all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in ip.split("."))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the patterns, leftmost and not overlapping within a kind."""
    found: list[tuple[str, int, int]] = []
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            found.append(("email", start, end))
        at = text.find("@", max(at + 1, end))
    for m in _NUMBERS.finditer(text):
        parts = m.group().split(".")
        start = m.start()
        for i in range(0, len(parts) - 3, 4):
            ip = ".".join(parts[i : i + 4])
            if small_parts(ip):
                found.append(("ip", start, start + len(ip)))
            start += len(ip) + 1
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= sum(map(str.isdigit, m.group())) <= 15:
            found.append(("phone", m.start(), m.end()))
    return found


# ---------------------------------------------------------------- the tagger

_SINGLE = " \n.,;:!?@+-()[]{}<>/\\=_%#*&|'\"$~^`"
CLASSES = {c: i for i, c in enumerate("abcdefghijklmnopqrstuvwxyz" + _SINGLE, 1)}
DIGIT, UPPER, LETTER, OTHER = (len(CLASSES) + k for k in range(1, 5))
N_CLASSES = OTHER + 1


def class_of(code: int) -> int:
    c = chr(code)
    return CLASSES.get(c) or (DIGIT if "0" <= c <= "9" else UPPER if "A" <= c <= "Z" else LETTER if c.isalpha() else OTHER)


_ASCII = np.array([class_of(c) for c in range(128)], np.int64)


def classes(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = _ASCII[np.minimum(codes, 127)]
    high = codes > 127
    if high.any():
        kinds, which = np.unique(codes[high], return_inverse=True)
        out[high] = np.array([class_of(int(c)) for c in kinds], np.int64)[which]
    return out


def made_example(rng: random.Random) -> tuple[str, list[tuple[str, int, int]]]:
    """A text with labelled spans: words of several alphabets, personal data, and look-alikes."""
    d = lambda n: "".join(rng.choices("0123456789", k=n))
    w = lambda a=2, b=9: "".join(rng.choices("etaoinshrdlucmfwypvbgkjqxzéüñçàß" if rng.random() < 0.3 else "etaoinshrdlucmfwypvbgkjqxz", k=rng.randint(a, b)))
    plain = lambda a=2, b=9: "".join(rng.choices("etaoinshrdlucmfwypvbgkjqxz", k=rng.randint(a, b)))

    def email():
        domain = ".".join([rng.choice([plain(), plain() + d(1), plain() + "-" + plain()])] + [plain() for _ in range(rng.random() < 0.3)] + [rng.choice(["com", "org", "net", "de", "fr", "es", "io", "co.uk"])])
        return rng.choice([plain(), plain() + "." + plain(), plain() + "." + d(2), plain() + d(rng.randint(1, 4)), plain() + "_" + plain(), plain(1, 1) + "+" + plain()]) + rng.choice(["@"] * 6 + [" @ ", "(at)", "[at]", " at "]) + domain

    def ip():
        return ".".join(str(rng.randint(0, 255)) for _ in range(4))

    def card():
        n = rng.choice([13, 15, 16, 16, 16, 19])
        body = rng.choice("3456") + d(n - 2)
        body += next(c for c in "0123456789" if luhn(body + c))
        sep = rng.choice(["", "", " ", "-"])
        return sep.join(body[i : i + 4] for i in range(0, n, 4))

    def phone():
        a, b, c = d(3), d(3), d(4)
        return rng.choice([f"+{rng.randint(1, 99)} ({a}) {b}-{c}", f"+{rng.randint(1, 99)} {a} {b} {c}", f"+{rng.randint(1, 99)}-{a}-{b}-{c}", f"+{rng.randint(1, 99)}{a}{b}{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+{rng.randint(1, 99)}.{a}.{b}.{c}"])

    def other():
        return rng.choice(
            [
                lambda: d(rng.randint(1, 7)),
                lambda: f"{d(1)}.{d(1)}",
                lambda: f"v{d(1)}.{d(2)}.{d(1)}",
                lambda: f"{rng.randint(1900, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}",
                lambda: f"{rng.randint(1, 28)}/{rng.randint(1, 12)}/{rng.randint(1900, 2030)}",
                lambda: f"{rng.randint(0, 23)}:{d(2)}",
                lambda: f"${d(3)},{d(3)}.{d(2)}",
                lambda: f"{rng.randint(1, 99)}%",
                lambda: "AKIA" + "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", k=16)),
                lambda: f'{rng.choice(["password", "token", "key", "secret"])}={rng.choice(["", chr(34)])}' + "".join(rng.choices("abcdef0123456789", k=rng.randint(8, 32))),
                lambda: '"' + "".join(rng.choices("abcdefghijklmnop0123456789", k=rng.randint(12, 32))) + '"',
                lambda: f"http://{plain()}.com/{plain()}/{d(3)}?page={d(1)}",
                lambda: f"@{plain()}",
                lambda: f"{d(20)}{d(rng.randint(1, 12))}",
                lambda: f"{plain()}{d(3)}",
                lambda: f"{d(3)}.{d(3)}.{d(3)}",
                lambda: f"ISBN {d(3)}-{d(1)}-{d(4)}-{d(4)}",
                lambda: f"({rng.randint(1900, 2030)})",
                lambda: f"{plain()} @ {d(1)}",
                lambda: f"{plain()} at {plain()}{rng.choice([',', '.', ''])}",
                lambda: f"{plain()} at {d(1)}.{d(1)}",
            ]
        )()

    make, text, spans = {"email": email, "ip": ip, "card": card, "phone": phone}, "", []
    while len(text) < WINDOW:
        r = rng.random()
        if r < 0.25:
            kind = rng.choice(KINDS)
            value = make[kind]()
            spans.append((kind, len(text), len(text) + len(value)))
            text += value
        elif r < 0.45:
            text += other()
        else:
            text += " ".join(rng.choice([w(), w().capitalize(), w().upper()]) if rng.random() < 0.15 else w() for _ in range(rng.randint(1, 4)))
        text += rng.choice([" "] * 8 + [", ", ". ", "\n", "; ", ": ", ")", " ("])
    return text, spans


def tags_of(n: int, spans: list[tuple[str, int, int]]) -> np.ndarray:
    tags = np.zeros(n, np.int64)
    for kind, a, b in spans:
        k = KINDS.index(kind)
        tags[a:b] = 2 + 2 * k
        if a < n:
            tags[a] = 1 + 2 * k
    return tags


def labelled(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """n windows of character classes and their tags; some start inside an example, some end early."""
    rng = random.Random(seed)
    x, y = np.zeros((n, WINDOW), np.int64), np.zeros((n, WINDOW), np.int64)
    for row in range(n):
        text, spans = made_example(rng)
        codes, tags = classes(text), tags_of(len(text), spans)
        start = rng.choice([0, 0, 0, rng.randint(0, 20)])
        while start and tags[start] and tags[start] % 2 == 0:
            start -= 1
        size = min(WINDOW if rng.random() < 0.7 else rng.randint(60, WINDOW), len(codes) - start)
        x[row, :size], y[row, :size] = codes[start : start + size], tags[start : start + size]
    return x, y


def allowed() -> np.ndarray:
    """0 where a tag may follow another, else -1e4: inside only after begin or inside of its kind."""
    out = np.zeros((TAGS, TAGS))
    for k in range(len(KINDS)):
        inside = 2 + 2 * k
        out[:, inside] = -1e4
        out[inside - 1, inside] = out[inside, inside] = 0
    return out


ALLOWED = allowed()
START = np.array([-1e4 if t and t % 2 == 0 else 0.0 for t in range(TAGS)])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return np.squeeze(m, axis) + np.log(np.exp(x - m).sum(axis=axis))


class Tagger:
    """Weights and passes of the network. Both directions run together, stacked on the first axis."""

    def __init__(self, hidden: int = 24, embed: int = 16, seed: int = 11):
        rng = np.random.default_rng(seed)
        n = lambda *s, k: rng.normal(0, k, s).astype(np.float32)
        self.hidden = hidden
        self.w = {
            "embed": n(N_CLASSES, embed, k=0.3),
            "wx": n(2, embed, 4 * hidden, k=embed**-0.5),
            "wh": n(2, hidden, 4 * hidden, k=hidden**-0.5),
            "b": np.zeros((2, 1, 4 * hidden), np.float32),
            "out": n(2 * hidden, TAGS, k=(2 * hidden) ** -0.5),
            "bias": np.zeros(TAGS, np.float32),
            "move": np.zeros((TAGS, TAGS), np.float32),
        }
        self.w["b"][:, :, hidden : 2 * hidden] = 1

    def forward(self, x: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
        """Tag scores (windows, WINDOW, TAGS); keep: what the backward pass needs."""
        w, hid = self.w, self.hidden
        both = np.stack([x, x[:, ::-1]])
        gates_x = w["embed"][both] @ w["wx"][:, None] + w["b"][:, None]
        n, length = x.shape
        h = c = np.zeros((2, n, hid), np.float32)
        hs, tape = np.empty((2, n, length, hid), np.float32), []
        for t in range(length):
            z = gates_x[:, :, t] + h @ w["wh"]
            s = sigmoid(z[..., : 3 * hid])
            i, f, o, g = s[..., :hid], s[..., hid : 2 * hid], s[..., 2 * hid :], np.tanh(z[..., 3 * hid :])
            before, old = h, c
            c = f * c + i * g
            tc = np.tanh(c)
            h = o * tc
            hs[:, :, t] = h
            if keep:
                tape.append((i, f, o, g, before, old, tc))
        joined = np.concatenate([hs[0], hs[1][:, ::-1]], axis=-1)
        return joined @ w["out"] + w["bias"], [both, joined, tape]

    def backward(self, d_scores: np.ndarray, kept: list) -> dict[str, np.ndarray]:
        w, hid = self.w, self.hidden
        both, joined, tape = kept
        grad = {k: np.zeros_like(v) for k, v in w.items()}
        grad["out"] = joined.reshape(-1, 2 * hid).T @ d_scores.reshape(-1, TAGS)
        grad["bias"] = d_scores.sum((0, 1))
        d_joined = d_scores @ w["out"].T
        d_hs = np.stack([d_joined[..., :hid], d_joined[:, ::-1, hid:]])
        dh = dc = np.zeros((2, d_scores.shape[0], hid), np.float32)
        d_gates = np.empty((2, d_scores.shape[0], len(tape), 4 * hid), np.float32)
        wh_t = w["wh"].transpose(0, 2, 1)
        for t in range(len(tape) - 1, -1, -1):
            i, f, o, g, before, old, tc = tape[t]
            dh = dh + d_hs[:, :, t]
            dc = dc + dh * o * (1 - tc * tc)
            dz = np.concatenate([dc * g * i * (1 - i), dc * old * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], axis=-1)
            d_gates[:, :, t] = dz
            grad["wh"] += before.transpose(0, 2, 1) @ dz
            dh, dc = dz @ wh_t, dc * f
        grad["b"] = d_gates.sum((1, 2))[:, None]
        flat = d_gates.reshape(2, -1, 4 * hid)
        e = w["embed"][both].reshape(2, -1, w["embed"].shape[1])
        grad["wx"] = e.transpose(0, 2, 1) @ flat
        # One row a class: the sum of what its places ask for.
        here = np.zeros((len(w["embed"]), both.size), flat.dtype)
        here[both.reshape(-1), np.arange(both.size)] = 1
        grad["embed"] = here @ (flat @ w["wx"].transpose(0, 2, 1)).reshape(both.size, -1)
        return grad

    def likelihood(self, scores: np.ndarray, tags: np.ndarray, real: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """CRF loss a character, and its gradients by scores and transitions. Padding counts as outside."""
        n, length, _ = scores.shape
        move = self.w["move"] + ALLOWED
        shift, most = np.exp(move.astype(np.float64)), scores.max(2, keepdims=True)
        chance = np.exp((scores - most).astype(np.float64))
        ahead, behind, size = np.empty_like(chance), np.ones_like(chance), np.empty((n, length, 1))

        v = chance[:, 0] * np.exp(START)
        for t in range(length):
            v = v if t == 0 else (v @ shift) * chance[:, t]
            size[:, t] = v.sum(1, keepdims=True)
            ahead[:, t] = v = v / size[:, t]
        for t in range(length - 2, -1, -1):
            behind[:, t] = (chance[:, t + 1] * behind[:, t + 1]) @ shift.T / size[:, t + 1]
        total = (np.log(size) + most).sum((1, 2))
        d_scores = ahead * behind
        pair = shift * (ahead[:, :-1].reshape(-1, TAGS).T @ (chance * behind / size)[:, 1:].reshape(-1, TAGS))
        rows = np.arange(n)[:, None], np.arange(length)[None, :]
        gold = scores[rows[0], rows[1], tags].sum(1) + START[tags[:, 0]] + move[tags[:, :-1], tags[:, 1:]].sum(1)
        d_scores[rows[0], rows[1], tags] -= 1
        np.add.at(pair, (tags[:, :-1], tags[:, 1:]), -1.0)
        count = max(1, int(real.sum()))
        return float((total - gold).sum() / count), (d_scores / n).astype(np.float32), (pair / n).astype(np.float32)

    def train(self, steps: int = 260, batch: int = 48, seed: int = 5, rate: float = 0.02) -> float:
        x, y = labelled(steps * batch // 3, seed)
        rng = np.random.default_rng(seed)
        first, second, loss = ({k: np.zeros_like(v) for k, v in self.w.items()} for _ in range(3))
        for step in range(1, steps + 1):
            rows = rng.integers(0, len(x), batch)
            scores, kept = self.forward(x[rows], True)
            loss, d_scores, d_move = self.likelihood(scores, y[rows], x[rows] > 0)
            grad = self.backward(d_scores, kept)
            grad["move"] = d_move
            norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
            speed, clip = rate * min(1.0, step / 20) * (1 - step / (steps + 1)), min(1.0, 20 / (norm + 1e-9))
            for k, g in grad.items():
                g = g * np.float32(clip)
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                self.w[k] -= (speed * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return loss

    def scores(self, x: np.ndarray, at_once: int = 128) -> np.ndarray:
        """What forward says, for use without training: windows lie along the last axis, and one product a step gives all gates."""
        w, hid, (n, length) = self.w, self.hidden, x.shape
        # sigmoid(z) = (1 + tanh(z / 2)) / 2, so one tanh serves all four gates.
        half = np.repeat(np.array([0.5, 0.5, 0.5, 1], np.float32), hid)[:, None]
        gates = np.concatenate([w["wh"], w["wx"], w["b"]], axis=1).transpose(0, 2, 1) * half
        embed, out = np.ascontiguousarray(w["embed"].T), w["out"].T
        found = np.empty((n, length, TAGS), np.float32)
        for at in range(0, n, at_once):
            codes = np.ascontiguousarray(x[at : at + at_once].T)
            size = codes.shape[1]
            e = np.ascontiguousarray(embed[:, codes].transpose(1, 0, 2))
            u, c, tc = np.zeros((2, hid + len(embed) + 1, size), np.float32), np.zeros((2, hid, size), np.float32), np.empty((2, hid, size), np.float32)
            u[:, -1] = 1
            z, hs, h = np.empty((2, 4 * hid, size), np.float32), np.empty((2, length, hid, size), np.float32), u[:, :hid]
            i, f, o, g = (z[:, k * hid : (k + 1) * hid] for k in range(4))
            for t in range(length):
                u[0, hid:-1], u[1, hid:-1] = e[t], e[length - 1 - t]
                np.matmul(gates, u, out=z)
                np.tanh(z, out=z)
                z[:, : 3 * hid] *= 0.5
                z[:, : 3 * hid] += 0.5
                c *= f
                i *= g
                c += i
                np.multiply(o, np.tanh(c, out=tc), out=h)
                hs[0, t], hs[1, length - 1 - t] = h[0], h[1]
            found[at : at + at_once] = (out[:, :hid] @ hs[0] + out[:, hid:] @ hs[1] + w["bias"][:, None]).transpose(2, 0, 1)
        return found

    def decode(self, scores: list[np.ndarray], edges: list[tuple[bool, bool]] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """The best tags of each piece, by Viterbi over all of it, and their marginal probabilities (1 where a piece is all outside: no span asks).

        edges: whether a piece begins and ends where its text does (else an outside stands there); by default both.
        """
        edges = edges or [(True, True)] * len(scores)
        tags = self.best_tags(scores, edges)
        some = [i for i, t in enumerate(tags) if t.any()]
        sure = dict(zip(some, self.marginals([scores[i] for i in some], [tags[i] for i in some], [edges[i] for i in some]), strict=True)) if some else {}
        return [(t, sure.get(i, np.ones(len(t), np.float32))) for i, t in enumerate(tags)]

    def strung(self, scores: list[np.ndarray], edges: list[tuple[bool, bool]]) -> tuple[np.ndarray, np.ndarray]:
        """Scores (BLOCK, TAGS, blocks) of the pieces one after another, a forced outside between them and all around; and where each starts.

        Blocks go together. A block starts from what a run-up over its neighbour's end says; where that
        isn't what the neighbour itself comes to, it goes again from there, until all agree (``agreed``).
        """
        lengths = [len(s) for s in scores]
        n = (sum(lengths) + len(scores)) // BLOCK + 1
        flat = np.full(((n + 2) * BLOCK, TAGS), -1e4, np.float32)
        flat[:, 0] = 0
        starts, move = BLOCK + np.cumsum([0, *(k + 1 for k in lengths)])[:-1], self.w["move"]
        for a, s, (first, last) in zip(starts, scores, edges, strict=True):
            if len(s):
                flat[a : a + len(s)] = s
                # At a text's own border neither the move from the outside before it nor the one to that after it counts.
                if first:
                    flat[a] -= np.where(START < 0, 0, move[0])
                if last:
                    flat[a + len(s) - 1] -= move[:, 0]
        return np.ascontiguousarray(flat.reshape(n + 2, BLOCK, TAGS).transpose(1, 2, 0)), starts

    def best_tags(self, scores: list[np.ndarray], edges: list[tuple[bool, bool]]) -> list[np.ndarray]:
        x, starts = self.strung(scores, edges)
        move, n = (self.w["move"] + ALLOWED).astype(np.float32), x.shape[2] - 2
        to_any, begun, within = move[:, [0, *range(1, TAGS, 2)], None], np.diag(move[1::2, 2::2])[:, None], np.diag(move[2::2, 2::2])[:, None]
        own, paths, tags = np.arange(1, n + 1), x.copy(), np.zeros((BLOCK, n + 2), np.int8)

        def best(v, steps, cols, keep):
            for t in steps:
                free, out = v[0] + to_any[0], x[t][:, cols]
                for k in range(1, TAGS):
                    np.maximum(free, v[k] + to_any[k], out=free)
                out[0] += free[0]
                out[1::2] += free[1:]
                out[2::2] += np.maximum(v[1::2] + begun, v[2::2] + within)
                v = out
                v -= v[0].copy()
                if keep:
                    paths[t][:, cols] = v
            return v

        def back(v, steps, cols, keep):
            tag = v[0]
            for t in steps:
                tag = (paths[t][:, cols] + move[:, tag]).argmax(0)
                if keep:
                    tags[t, cols] = tag
            return tag[None]

        agreed(lambda v, c: best(v, range(BLOCK), c, True), best(np.zeros((TAGS, n), np.float32), range(BLOCK - RUN_UP, BLOCK), own - 1, False), own, 1e-2)
        agreed(lambda v, c: back(v, range(BLOCK - 1, -1, -1), c, True), back(np.zeros((1, n), np.int64), range(RUN_UP - 1, -1, -1), own + 1, False), own, 0, -1)
        tags = tags.T.reshape(-1)
        return [tags[a : a + len(s)].astype(np.int64) for a, s in zip(starts, scores, strict=True)]

    def marginals(self, scores: list[np.ndarray], tags: list[np.ndarray], edges: list[tuple[bool, bool]]) -> list[np.ndarray]:
        """Probability of each of the tags under the CRF."""
        chance, starts = self.strung(scores, edges)
        n, shift = chance.shape[2] - 2, np.exp((self.w["move"] + ALLOWED).astype(np.float32))
        chance -= chance.max(1, keepdims=True)
        np.exp(chance, out=chance)
        chosen = np.zeros((n + 2) * BLOCK, np.int8)
        for a, t in zip(starts, tags, strict=True):
            chosen[a : a + len(t)] = t
        chosen = np.ascontiguousarray(chosen.reshape(n + 2, BLOCK).T)
        own, ahead, share = np.arange(1, n + 1), np.empty_like(chance), np.ones((BLOCK, n + 2), np.float32)

        def forward(v, steps, cols, keep):
            for t in steps:
                v = (shift.T @ v) * chance[t][:, cols]
                v /= v.sum(0)
                if keep:
                    ahead[t][:, cols] = v
            return v

        def backward(v, steps, cols, keep):
            """v: how likely what follows is, by the tag of the step."""
            for t in steps:
                if keep:
                    both = ahead[t][:, cols] * v
                    share[t, cols] = both[chosen[t, cols], np.arange(len(cols))] / both.sum(0)
                v = shift @ (v * chance[t][:, cols])
                v /= v.sum(0)
            return v

        even = np.full((TAGS, n), 1 / TAGS, np.float32)
        agreed(lambda v, c: forward(v, range(BLOCK), c, True), forward(even, range(BLOCK - RUN_UP, BLOCK), own - 1, False), own, 1e-6)
        agreed(lambda v, c: backward(v, range(BLOCK - 1, -1, -1), c, True), backward(even, range(RUN_UP - 1, -1, -1), own + 1, False), own, 1e-6, -1)
        flat = share.T.reshape(-1)
        return [flat[a : a + len(t)] for a, t in zip(starts, tags, strict=True)]


def agreed(run, state: np.ndarray, own: np.ndarray, tolerance: float, way: int = 1) -> None:
    """Runs all blocks, each from its column of ``state``, then again those whose neighbour (before; way -1: after) ends elsewhere."""
    ends = run(state, own)
    while True:
        wanted = state.copy()
        if way == 1:
            wanted[:, 1:] = ends[:, :-1]
        else:
            wanted[:, :-1] = ends[:, 1:]
        floor = -1e3 if state.dtype == np.float32 else None
        off = np.abs(np.clip(wanted, floor, None) - np.clip(state, floor, None)) if floor else np.abs(wanted - state)
        bad = np.flatnonzero(off.max(0) > tolerance)
        if not len(bad):
            return
        state[:, bad] = wanted[:, bad]
        ends[:, bad] = run(state[:, bad], own[bad])


def tagged(tagger: Tagger, texts: list[str], windows_at_once: int = 4096, where: list[list[tuple[int, int]]] | None = None) -> list[list[tuple[str, int, int]]]:
    """The tagger's spans of each whole text.

    where: of each text the stretches outside of which every character is outside. That makes each stretch a
    problem of its own, for which only the windows that own its characters are run.
    """
    found: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    pieces = [(i, a, b) for i, x in enumerate(texts) for a, b in (where[i] if where is not None else [(0, len(x))]) if a < b]
    at = 0
    while at < len(pieces):
        # A group of pieces of about as many windows as go at once; a longer one alone.
        group, n = [], 0
        while at < len(pieces) and (not group or n < windows_at_once):
            group.append(pieces[at])
            n += 2 + (pieces[at][2] - pieces[at][1]) // SHIFT
            at += 1
        asked: dict[tuple[int, int], list[int]] = {}
        for g, (i, a, b) in enumerate(group):
            last = max(0, len(texts[i]) - (WINDOW - SHIFT) - 1) // SHIFT
            for k in range(owner(a, last), owner(b - 1, last) + 1):
                asked.setdefault((i, k), []).append(g)
        scores = [np.zeros((b - a, TAGS), np.float32) for _, a, b in group]
        windows = iter(asked.items())
        while some := list(itertools.islice(windows, windows_at_once)):
            x, parts, end = np.zeros((len(some), WINDOW), np.int64), [texts[i][k * SHIFT : k * SHIFT + WINDOW] for (i, k), _ in some], 0
            codes = classes("".join(parts))
            for row, part in enumerate(parts):
                x[row, : len(part)] = codes[end : end + len(part)]
                end += len(part)
            for ((i, k), users), y in zip(some, tagger.scores(x), strict=True):
                # A character of two windows takes the one whose border is farther.
                s, size = k * SHIFT, len(texts[i])
                e = min(s + WINDOW, size)
                lo = s if s == 0 else s + (WINDOW - SHIFT) // 2
                hi = e if e == size else e - (WINDOW - SHIFT) // 2
                for g in users:
                    _, a, b = group[g]
                    left, right = max(a, lo), min(b, hi)
                    scores[g][left - a : right - a] = y[left - s : right - s]
        edges = [] if where is None else [[(a == 0, b == len(texts[i])) for i, a, b in group]]
        for (i, a, _), (tags, sure) in zip(group, tagger.decode(scores, *edges), strict=True):
            found[i] += [(kind, a + lo, a + hi) for kind, lo, hi in spans_of(tags, sure)]
    return found


def owner(place: int, last: int) -> int:
    """The window, of those up to ``last``, in which a character lies most centrally."""
    return min(max(0, place - (WINDOW - SHIFT) // 2) // SHIFT, last)


def spans_of(tags: np.ndarray, sure: np.ndarray) -> list[tuple[str, int, int]]:
    """Runs of one kind's tags, of which the tagger is sure."""
    out = []
    for at in np.flatnonzero(tags % 2):
        inside, end = int(tags[at]) + 1, int(at) + 1
        while end < len(tags) and tags[end] == inside:
            end += 1
        if sure[at:end].mean() >= SURE:
            out.append((KINDS[inside // 2 - 1], int(at), end))
    return out


_HOST = r"[A-Za-z0-9-]+(?:(?:\.|[(\[]dot[)\]])[A-Za-z0-9-]+)+"
_HOST_AT = re.compile(" ?" + _HOST)
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+(?: ?(?:@|[(\[]at[)\]]) ?" + _HOST + r"| at (?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,})")
_IP = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
_CARD_FORM = re.compile(r"[0-9][ .0-9-]*[0-9]")
_PHONE_FORM = re.compile(r"[+(]?[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[+(]?[0-9][ ().0-9-]*[0-9]")


def plausible(kind: str, value: str) -> bool:
    """The plain check that a span of the tagger must pass."""
    digits = "".join(c for c in value if "0" <= c <= "9")
    if kind == "email":
        return bool(_EMAIL.fullmatch(value))
    if kind == "ip":
        return bool(_IP.fullmatch(value)) and small_parts(value)
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits) and len(value) <= len(digits) + 6 and bool(_CARD_FORM.fullmatch(value))
    return 10 <= len(digits) <= 15 and bool(_PHONE_FORM.fullmatch(value)) and any(c in "+(-." for c in value)


def possible(text: str) -> list[tuple[int, int]]:
    """Stretches, in order and apart, one of which holds any span that ``plausible`` takes; in time linear in the text."""
    found = []
    # Numbers: a run of digits and what may part them holds each ip, card and phone of it whole.
    for m in _DIGITS.finditer(text):
        run = m.group()
        n = len(run) if run.isdecimal() else sum(map(run.count, "0123456789"))
        if n >= 10 or run.count(".") >= 3:
            found.append(m.span())
    # Emails: the local part before each sign, and the host after it.
    for sign in ("@", "at)", "at]", " at "):
        at = text.find(sign)
        while at >= 0:
            start, end = at, at + len(sign)
            if sign[0] == "a":
                start -= 1
            if (sign[0] != "a" or start >= 0 and text[start] in "([") and (m := _HOST_AT.match(text, end)):
                left = start - (sign != " at " and start > 0 and text[start - 1] == " ")
                a = left
                while a > 0 and text[a - 1] in _LOCAL:
                    a -= 1
                if a < left:
                    found.append((a, m.end()))
            at = text.find(sign, at + 1)
    out: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


@functools.cache
def trained() -> Tagger:
    """The tagger, trained once in a driver; its weights go to the tasks."""
    tagger = Tagger()
    tagger.train()
    return tagger


def scanned(tagger: Tagger, texts: list[str]) -> list[tuple[list, list]]:
    """Base spans and all spans of each text, by kind and then start."""
    order = lambda x: (KINDS.index(x[0]), x[1], x[2])
    out = []
    for text, more in zip(texts, tagged(tagger, texts, where=[possible(x) for x in texts]), strict=True):
        base = base_spans(text)
        by_start = sorted((a, b) for _, a, b in base)
        starts, ends = [a for a, _ in by_start], list(itertools.accumulate((b for _, b in by_start), max))
        free = lambda a, b: not (k := bisect_left(starts, b)) or ends[k - 1] <= a  # noqa: B023, E731
        added = [x for x in more if free(*x[1:]) and plausible(x[0], text[x[1] : x[2]])]
        out.append((sorted(base, key=order), sorted(base + added, key=order)))
    return out


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def found_spans(docs: DataFrame, tagger: Tagger | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, base and spans (arrays of kind, start, end in code points, end exclusive) of each whole text.

    Null or empty text: no spans. Malformed UTF-8 reads as U+FFFD. Null keys and repeated rows give a row each; other columns are left
    out. An empty table gives an empty table.
    """
    tagger = tagger or trained()
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def make():
        claim("pii", lambda: None)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = scanned(tagger, [x.decode() for x in batch.column(1).to_pylist()])
            as_rows = lambda k: pa.array([[dict(zip(("kind", "start", "end"), s, strict=True)) for s in x[k]] for x in found], span)
            return pa.RecordBatch.from_arrays([batch.column(0), as_rows(0), as_rows(1)], names=["key", "base", "spans"])

        return each

    kind = docs.schema[key].dataType.simpleString()
    spans = "array<struct<kind:string,start:bigint,end:bigint>>"
    return map_batches(docs.select(F.col(key).alias("key"), utf8(text).alias("raw")), make, f"key {kind}, base {spans}, spans {spans}").withColumnRenamed("key", key)


def redacted_text(text: str, spans: list[tuple[str, int, int]]) -> str:
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda x: (x[1], -x[2])):
        if b <= at:
            continue
        out += [text[at:a] if a > at else "", f"<{kind.upper()}>" if a >= at else ""]
        at = b
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame, tagger: Tagger | None = None, text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """The rows with all their columns; every span found is replaced by <KIND>, and ``length``, where there is such a column, follows.

    Null text stays null; malformed UTF-8 comes out as U+FFFD.
    """
    tagger = tagger or trained()

    @F.arrow_udf("string")
    def clean(raw: pa.Array) -> pa.Array:
        claim("pii", lambda: None)
        texts = raw.to_pylist()
        at = [i for i, x in enumerate(texts) if x]
        for i, (_, spans) in zip(at, scanned(tagger, [texts[i] for i in at]), strict=True):
            texts[i] = redacted_text(texts[i], spans)
        return pa.array(texts, pa.string())

    from .common import small_batches

    small_batches(docs.sparkSession)
    out = docs.withColumn(text, clean(F.make_valid_utf8(text)))
    if length in docs.columns:
        out = out.withColumn(length, F.when(F.col(length).isNotNull(), F.length(text)).cast(docs.schema[length].dataType))
    return out.select(docs.columns)


def op3(docs: DataFrame) -> DataFrame:
    say = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found_spans(docs).select("doc_id", *map(count, KINDS), F.sha2(say("base"), 256).alias("base_sha256"), say("spans").alias("spans"))


