"""Personal data: exact patterns, and a character BiLSTM with CRF transitions trained in numpy.

The base finds e-mail addresses, IP addresses, card and phone numbers by fixed
patterns. The tagger adds spans of these kinds that the patterns miss: numbers
without a country code, addresses with their signs spelt out or in brackets,
dotted cards. It is trained on labelled spans, drawn from a seeded generator,
when first needed, and has a few thousand weights whatever the corpus.

Overlapping windows are laid over every whole text. Those that hold what any span
that counts must hold (``_TRIGGER``), and the windows beside them, are scored and
each character takes the mean of its windows' scores (more weight to those it
stands in the middle of). Where no label comes within ``QUIET`` of "outside" for
``APART`` characters, the text falls apart into stretches; one Viterbi pass
decodes each whole stretch, so no span is cut at a window's edge. A tagged span
counts if it has the make-up of its kind and touches no base span.
"""

from __future__ import annotations

import os
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, utf8

KINDS = ("email", "ip", "card", "phone")

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, found from their at signs, so in time linear in the text."""
    out, at, floor = [], text.find("@"), 0
    while at >= 0:
        left = at
        while left > floor and text[left - 1] in _LOCAL:
            left -= 1
        floor = at + 1
        if left < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((left, m.end()))
            floor = m.end()
        at = text.find("@", floor)
    return out


def ips(text: str) -> list[tuple[int, int]]:
    """Four numbers of a dotted run at a time."""
    out = []
    for run in _DOTTED.finditer(text):
        parts, at = run[0].split("."), run.start()
        while len(parts) >= 4:
            size = sum(map(len, parts[:4])) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in parts[:4]):
                out.append((at, at + size))
            at += size + 1
            parts = parts[4:]
    return out


def cards(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _CARD.finditer(text) if m.end() - m.start() <= 37 and 12 <= len(d := re.sub(r"[\x20-]", "", m[0])) <= 19 and _luhn(d)]


def phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _PHONE.finditer(text) if 9 <= len(_DIGITS.findall(m[0])) <= 15] if "+" in text else []


def base(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all base spans in order."""
    return sorted((a, k, b) for k, find in enumerate((emails, ips, cards, phones)) for a, b in find(text))


# --- the tagger ---------------------------------------------------------------------------------

#: Characters of a window to learn from; of one to score, and how far the next is off.
WINDOW = 64
SCORED, STRIDE = 128, 96
HIDDEN = 16
#: Log-odds by which "outside" leads every other label where nothing can be, and characters of such quiet between stretches.
QUIET, APART = 7.0, 4
#: Characters of a text that are scored at once.
SECTION = 1 << 18
#: Labels: 0 outside; 1 + 2 k begins and 2 + 2 k continues a span of kind k.
LABELS = 1 + 2 * len(KINDS)
#: Character classes: ASCII (capitals as small letters), other letters, the rest; 0 pads.
CLASSES = 130


def _classes(text: str) -> np.ndarray:
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    code = np.where((code >= ord("A")) & (code <= ord("Z")), code + 32, code)
    return np.where(code < 128, code, np.where(code >= 0xC0, 128, 129)).astype(np.int64)


GATE, HALF = np.float32(0.25), np.float32(0.5)


class Tagger:
    """A bidirectional LSTM over character classes with a linear-chain CRF on top."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = weights

    @staticmethod
    def fresh(seed: int = 11) -> Tagger:
        rng = np.random.default_rng(seed)
        w = {}
        for d in "fb":
            w[f"x{d}"] = rng.normal(0, 0.3, (CLASSES, 4 * HIDDEN))
            w[f"x{d}"][:, HIDDEN : 2 * HIDDEN] += 1.0  # forget gates start open
            w[f"u{d}"] = rng.normal(0, 1 / HIDDEN**0.5, (HIDDEN, 4 * HIDDEN))
        w["o"] = rng.normal(0, 0.3, (2 * HIDDEN, LABELS))
        w["c"] = np.zeros(LABELS)
        w["t"] = np.zeros((LABELS, LABELS))
        return Tagger({k: v.astype(np.float32) for k, v in w.items()})

    def _run(self, x: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """Hidden states of one direction: (batch, time, HIDDEN)."""
        table, u = self.w[f"x{d}"], self.w[f"u{d}"]
        n, time = x.shape
        h = np.zeros((n, HIDDEN), np.float32)
        c = np.zeros((n, HIDDEN), np.float32)
        out = np.empty((n, time, HIDDEN), np.float32)
        for t in range(time) if d == "f" else range(time - 1, -1, -1):
            gates = table[x[:, t]] + h @ u
            # Gates by a clipped line, states by x / (1 + |x|): a third of the time of the exponentials.
            ifo = np.minimum(np.maximum(gates[:, : 3 * HIDDEN] * GATE + HALF, 0), 1)
            g = gates[:, 3 * HIDDEN :]
            g = g / (1 + np.abs(g))
            old, before = c, h
            c = ifo[:, HIDDEN : 2 * HIDDEN] * c + ifo[:, :HIDDEN] * g
            tc = c / (1 + np.abs(c))
            h = ifo[:, 2 * HIDDEN :] * tc
            out[:, t] = h
            if keep is not None:
                keep.append((t, ifo, g, old, tc, before))
        return out

    def emissions(self, x: np.ndarray) -> np.ndarray:
        h = np.concatenate([self._run(x, "f"), self._run(x, "b")], axis=2)
        return h @ self.w["o"] + self.w["c"]

    def decode(self, e: np.ndarray) -> np.ndarray:
        """The best label sequence of one stretch's scores, by Viterbi."""
        t = self.w["t"]
        best = e[0] - np.where(_ENTRY, 0, 1e4)
        back = np.empty((len(e), LABELS), np.int64)
        for i in range(1, len(e)):
            total = best[:, None] + t - _BARRED
            back[i] = total.argmax(0)
            best = total.max(0) + e[i]
        out = np.empty(len(e), np.int64)
        out[-1] = best.argmax()
        for i in range(len(e) - 1, 0, -1):
            out[i - 1] = back[i, out[i]]
        return out

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss (negative log-likelihood a character) and its gradients."""
        n, time = x.shape
        kept: dict[str, list] = {"f": [], "b": []}
        h = np.concatenate([self._run(x, d, kept[d]) for d in "fb"], axis=2)
        e = h @ self.w["o"] + self.w["c"]
        t = self.w["t"]
        alpha, beta = np.empty_like(e), np.zeros_like(e)
        alpha[:, 0] = e[:, 0]
        for i in range(1, time):
            alpha[:, i] = e[:, i] + _logsum(alpha[:, i - 1, :, None] + t, 1)
        for i in range(time - 2, -1, -1):
            beta[:, i] = _logsum(t + (e[:, i + 1] + beta[:, i + 1])[:, None, :], 2)
        z = _logsum(alpha[:, -1], 1)
        scale = np.float32(1 / (n * time))
        de = np.exp(alpha + beta - z[:, None, None])
        rows, cols = np.arange(n)[:, None], np.arange(time)
        gold = e[rows, cols, y].sum() + t[y[:, :-1], y[:, 1:]].sum()
        de[rows, cols, y] -= 1
        pair = np.exp(alpha[:, :-1, :, None] + t + (e + beta)[:, 1:, None, :] - z[:, None, None, None])
        dt = pair.sum((0, 1))
        np.subtract.at(dt, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
        de *= scale
        grads = {"t": dt * scale, "o": np.einsum("nth,ntl->hl", h, de), "c": de.sum((0, 1))}
        dh = de @ self.w["o"].T
        for k, d in enumerate("fb"):
            u = self.w[f"u{d}"]
            du, dx, all_dg = np.zeros_like(u), np.zeros_like(self.w[f"x{d}"]), []
            later = np.zeros((n, HIDDEN), np.float32)
            dc = np.zeros((n, HIDDEN), np.float32)
            for i, ifo, g, old, tc, before in reversed(kept[d]):
                dhi = dh[:, i, k * HIDDEN : (k + 1) * HIDDEN] + later
                o = ifo[:, 2 * HIDDEN :]
                dc = dc + dhi * o * (1 - np.abs(tc)) ** 2
                dg = np.concatenate([dc * g, dc * old, dhi * tc], 1) * ((ifo > 0) & (ifo < 1)) * GATE
                dg = np.concatenate([dg, dc * ifo[:, :HIDDEN] * (1 - np.abs(g)) ** 2], 1)
                all_dg.append((i, dg))
                du += before.T @ dg
                later = dg @ u.T
                dc = dc * ifo[:, HIDDEN : 2 * HIDDEN]
            seen = x[:, [i for i, _ in all_dg]].T.ravel()
            order = np.argsort(seen, kind="stable")
            known, first = np.unique(seen[order], return_index=True)
            dx[known] = np.add.reduceat(np.concatenate([g for _, g in all_dg])[order], first)
            grads[f"x{d}"], grads[f"u{d}"] = dx, du
        return float((z.sum() - gold) * scale), grads


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis)) + top.squeeze(axis)


#: A span is entered by its first label only.
_ENTRY = np.array([lab == 0 or lab % 2 == 1 for lab in range(LABELS)])
_BARRED = np.array([[0 if _ENTRY[b] or a in (b, b - 1) else 1e4 for b in range(LABELS)] for a in range(LABELS)], np.float32)


def _word(r: random.Random) -> str:
    parts = ("th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "or", "ti", "st", "ar", "te", "ção", "é", "ü", "sch", "ión", "que", "mo", "li", "ka")
    w = "".join(r.choice(parts) for _ in range(r.randint(1, 4)))
    return r.choice((w, w, w, w.capitalize(), w.upper())) + r.choice(("", "", "", "", "", ".", ",", "***", "!!", "%%%", " |"))


def _digits(r: random.Random, n: int) -> str:
    return "".join(r.choice("0123456789") for _ in range(n))


def _entity(r: random.Random) -> tuple[str, int]:
    """A labelled span: (text, kind); kind -1: a number or sign that is none."""
    k = r.randint(0, 13)
    name = re.sub(r"\W", "", _word(r).lower()) or "ann"
    if r.random() < 0.6:
        name += r.choice(("", ".", "_")) + r.choice((_digits(r, 2), re.sub(r"\W", "", _word(r).lower()), r.choice("abcdehjkmst")))
    parts = [r.choice(("mail", "post", "web", "inbox", "team", "info", "")) + r.choice(("", str(r.randint(0, 9)))), re.sub(r"\W", "", _word(r).lower()) or "example", r.choice(("com", "org", "net", "de", "io", "fr"))]
    parts = [p for p in parts if p]
    group = (_digits(r, 3), _digits(r, 3), _digits(r, 4))
    if k == 0:
        return f"{name}@{'.'.join(parts)}", 0
    if k in (1, 2):
        at = r.choice((" [at] ", " (at) ", "[at]", "(at)", " [AT] ", " AT ", " at ", "{at}", " <at> "))
        dot = r.choice((" [dot] ", " (dot) ", "[dot]", " DOT ", " dot ")) if r.random() < 0.5 or at in (" at ", " AT ") else "."
        return name + at + dot.join(parts), 0
    if k == 3:
        return ".".join(str(r.randint(0, 255)) for _ in range(4)), 1
    if k == 4:
        return r.choice(("[.]", "(.)", " . ", "[dot]", " dot ")).join(str(r.randint(0, 255)) for _ in range(4)), 1
    if k in (5, 6):
        d = _digits(r, 15)
        d += next(c for c in "0123456789" if _luhn(d + c))
        return d if k == 5 and r.random() < 0.3 else r.choice((" ", "-") if k == 5 else (".", "  ", "/", "_", " - ")).join(d[i : i + 4] for i in range(0, 16, 4)), 2
    if k == 7:
        return r.choice(("+1 (%s) %s-%s", "+1 %s %s %s", "+49 %s %s%s")) % group, 3
    if k in (8, 9):
        return r.choice(("(%s) %s-%s", "%s-%s-%s", "(%s) %s %s", "%s.%s.%s", "0%s/%s%s", "00 1 %s %s %s", "%s %s %s")) % group, 3
    if k == 10:
        return "token = \"" + "".join(r.choice("0123456789abcdef") for _ in range(40)) + '"', -1
    if k == 11:
        return r.choice(("version 2.0", "version 3.", "CC BY-NC 4.0.", "1999", "3.14", "12,500", "50%", "1.2.3", "10:45", "2024-01-31", "31.12.2023", "1 000 000", "12 34 56", "at home", "dot the i", "look at it", "1, 2, 3, 4", "1.2.3.4.5.6")), -1
    if k == 12:
        return r.choice((_digits(r, r.randint(1, 8)), f"{_digits(r, 3)},{_digits(r, 3)},{_digits(r, 3)}", f"{r.randint(1900, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)} 1{r.randint(0, 9)}:{r.randint(10, 59)}", f"{_word(r)} at {_word(r)}", " ".join(_digits(r, 2) for _ in range(3)))), -1
    return r.choice(("@", "a @ b", "@" + name, "p. 12", "No. 7", "#42", "1-2", "2/3", "(3)", "[7]", "1) 2) 3)", "at the dot", " | ", "***", "§ 12.3")), -1


def labelled(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """n windows of text with labelled spans: (classes, labels)."""
    r = random.Random(seed)
    x, y = np.zeros((n, WINDOW), np.int64), np.zeros((n, WINDOW), np.int64)
    for i in range(n):
        text, lab = "", []
        lead = r.randint(0, 6)
        while len(text) < WINDOW + 24:
            if lead:
                piece, kind = _word(r), -1
                lead -= 1
            else:
                piece, kind = _entity(r)
                lead = r.randint(1, 8)
            lab += [0] * len(piece) if kind < 0 else [1 + 2 * kind] + [2 + 2 * kind] * (len(piece) - 1)
            text += piece
            glue = r.choice((" ", " ", " ", " ", "\n", ". ", ", ", "&&& "))
            text += glue
            lab += [0] * len(glue)
        at = r.randint(0, len(text) - WINDOW)
        x[i] = _classes(text)[at : at + WINDOW]
        y[i] = lab[at : at + WINDOW]
    return x, y


_TRAINED: dict[tuple[int, int, int], dict[str, np.ndarray]] = {}


def train(steps: int = 1000, batch: int = 64, seed: int = 5) -> Tagger:
    """A tagger trained by Adam on seeded labelled windows; the same for the same arguments."""
    key = (steps, batch, seed)
    if key not in _TRAINED:
        model = Tagger.fresh()
        x, y = labelled(steps * batch // 4, seed)
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in model.w.items()}
        v = {k: np.zeros_like(w) for k, w in model.w.items()}
        for step in range(1, steps + 1):
            pick = rng.integers(0, len(x), batch)
            _, grads = model.gradients(x[pick], y[pick])
            norm = max(1.0, float(np.sqrt(sum((g * g).sum() for g in grads.values()))))
            rate = 0.02 * min(1, step / 20) * (1 - step / (steps + 1))
            for k, g in grads.items():
                g = g / norm
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                model.w[k] = (model.w[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        _TRAINED[key] = model.w
    return Tagger(_TRAINED[key])


def fitted() -> Tagger:
    """The tagger of train()'s default arguments: its weights lie beside this file.

    ``python -m platen.llm.pii`` makes them anew, from the seed.
    """
    path = os.path.join(os.path.dirname(os.path.abspath(__file__)), "pii_weights.npz")
    if not os.path.exists(path):
        return train()
    with np.load(path) as held:
        return Tagger({k: held[k] for k in held.files})


_CENTRAL = (np.minimum(np.arange(SCORED), np.arange(SCORED)[::-1]) + 1).astype(np.float32)
#: An address in any spelling of its signs.
_SPELT = re.compile(
    r"[\w.%+-]+\s?(?:@|[\[({<]?\bat\b[\])}>]?)\s?[\w-]+(?:(?:\.|\s?[\[({<]?\bdot\b[\])}>]?\s?)[\w-]+)+", re.I
)
#: What any span that counts holds: a digit, or an address's sign with the start of a domain.
_TRIGGER = re.compile(r"[0-9@]|\bat\b[\])}>]?\s?[\w-]+(?:\.[\w-]|\s?[\[({<]?\bdot\b)", re.I)


def _plausible(kind: int, text: str) -> bool:
    """Whether a tagged span has the make-up of its kind, in whatever spelling."""
    n = len(_DIGITS.findall(text))
    if kind == 0:
        return bool(_SPELT.fullmatch(text))
    if kind == 1:
        numbers = re.findall(r"[0-9]+", text)
        return len(numbers) == 4 and all(len(x) <= 3 and int(x) <= 255 for x in numbers) and len(text) <= 39
    if kind == 2:
        return 12 <= n <= 19 and _luhn("".join(_DIGITS.findall(text))) and len(text) <= 2 * n + 6
    return 9 <= n <= 15 and bool(re.fullmatch(r"[+(]?[0-9][\x20()./0-9-]*[0-9]", text)) and bool(re.search(r"[\x20()./-]", text))


def _scores(model: Tagger, text: str, codes: np.ndarray, a: int, b: int, all_windows: bool = False) -> np.ndarray:
    """The scores of characters a to b of a text, from windows that lie at multiples of STRIDE.

    A window without a trigger, and whose neighbours have none, can hold no
    part of a span that counts: its characters are "outside" without a look.
    """
    first = max(0, (a - SCORED) // STRIDE + 1)
    starts = np.arange(first * STRIDE, b, STRIDE)
    low, high = int(starts[0]), int(starts[-1]) + SCORED
    asked = np.full(len(starts) + 2, all_windows)
    for m in _TRIGGER.finditer(text, max(0, low - 4 * SCORED), min(len(text), high + 8 * SCORED)):
        k = m.start() // STRIDE - first + 1
        asked[max(0, k - 2) : max(0, k + 2)] = True
    some = np.flatnonzero(asked[1:-1])
    total, weight = np.zeros((high - low, LABELS), np.float32), np.zeros(high - low, np.float32)
    if len(some):
        padded = np.concatenate([codes[low:high], np.zeros(SCORED, np.int64)])
        x = np.lib.stride_tricks.sliding_window_view(padded, SCORED)[starts[some] - low]
        for k in range(0, len(some), 512):
            for e, s in zip(model.emissions(x[k : k + 512]), starts[some[k : k + 512]] - low):
                total[s : s + SCORED] += e * _CENTRAL[:, None]
                weight[s : s + SCORED] += _CENTRAL
    total /= np.maximum(weight, 1)[:, None]
    total[weight == 0, 1:] = -1e4
    return total[a - low : b - low]


def _stretches(e: np.ndarray) -> list[tuple[int, int]]:
    """The parts of some scored characters in which a span can lie, apart from each other."""
    near = np.flatnonzero(e[:, 1:].max(1) > e[:, 0] - QUIET)
    if not len(near):
        return []
    gaps = np.flatnonzero(np.diff(near) > APART)
    firsts, lasts = near[np.concatenate([[0], gaps + 1])], near[np.concatenate([gaps, [len(near) - 1]])]
    return [(max(0, a - 1), min(len(e), b + 2)) for a, b in zip(firsts.tolist(), lasts.tolist())]


def tagged(model: Tagger, texts: list[str], all_windows: bool = False) -> list[list[tuple[int, int, int]]]:
    """(start, kind, end) of the tagger's spans in each text."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    short = [i for i, t in enumerate(texts) if 0 < len(t) <= SECTION // 8]
    long = [i for i, t in enumerate(texts) if len(t) > SECTION // 8]
    # Short texts are scored together. Each begins at a multiple of STRIDE, line
    # feeds around it, so that its windows are the same whatever stands beside it.
    while short:
        taken, size = 0, 0
        while taken < len(short) and size < SECTION:
            size += len(texts[short[taken]]) + LEAD
            taken += 1
        group, short = short[:taken], short[taken:]
        text, starts = _laid([texts[i] for i in group])
        e = _scores(model, text, _classes(text), 0, len(text), all_windows)
        for a, b in _stretches(e):
            found: list[tuple[int, int, int]] = []
            _decoded(model, text, a, e[a:b], found)
            for x, kind, y in found:
                k = int(np.searchsorted(starts, x, "right")) - 1
                out[group[k]].append((x - int(starts[k]), kind, y - int(starts[k])))
    for i in long:
        text, starts = _laid([texts[i]])
        codes, at, size, found = _classes(text), 0, SECTION, []
        # Sections of a long text end in quiet, so that no stretch is cut (but one of 16 sections).
        while at < len(text):
            end = min(len(text), at + size)
            e = _scores(model, text, codes, at, end, all_windows)
            parts = _stretches(e)
            if end < len(text) and parts and parts[-1][1] >= len(e) - 1 - APART:
                if parts[-1][0] == 0 and size < 16 * SECTION:
                    size *= 2
                    continue
                if parts[-1][0] > 0:
                    end = at + parts.pop()[0]
            size = SECTION
            for a, b in parts:
                _decoded(model, text, at + a, e[a:b], found)
            at = end
        out[i] = [(x - LEAD, kind, y - LEAD) for x, kind, y in found]
    return out


#: Line feeds before the first text of a group: a multiple of STRIDE, and more than a window.
LEAD = 2 * STRIDE


def _laid(texts: list[str]) -> tuple[str, np.ndarray]:
    """Texts one after another with line feeds between, and where each begins."""
    parts, starts, at = ["\n" * LEAD], [], LEAD
    for t in texts:
        gap = LEAD + -len(t) % STRIDE
        parts += [t, "\n" * gap]
        starts.append(at)
        at += len(t) + gap
    return "".join(parts), np.array(starts)


def _decoded(model: Tagger, text: str, at: int, e: np.ndarray, out: list[tuple[int, int, int]]) -> None:
    """Adds the plausible spans of one stretch, whose first character is at ``at``."""
    if (e[:, 1:].max(1) < e[:, 0] - 2 * QUIET).all():
        return
    path = model.decode(e)
    for s in np.flatnonzero(path % 2 == 1).tolist():
        kind, end = (int(path[s]) - 1) // 2, s + 1
        while end < len(path) and path[end] == path[s] + 1:
            end += 1
        piece = text[at + s : at + end]
        trimmed = piece.strip(" \n.,;:!&*%|")
        start = at + s + piece.find(trimmed)
        if kind == 0 and trimmed:  # to the borders of its words
            stop = start + len(trimmed)
            while start and (text[start - 1].isalnum() or text[start - 1] in "._%+-"):
                start -= 1
            while stop < len(text) and (text[stop].isalnum() or text[stop] == "-"):
                stop += 1
            trimmed = text[start:stop]
        if trimmed and _plausible(kind, trimmed):
            out.append((start, kind, start + len(trimmed)))
        elif kind == 2:  # several numbers in a row: each unbroken one by itself
            out += [(start + m.start(), 2, start + m.end()) for m in re.finditer(r"[0-9]+", trimmed) if _plausible(2, m[0])]


def spans_of(model: Tagger, texts: list[str]) -> list[tuple[list, list]]:
    """Per text its base spans, and all spans: the base's and the tagger's that touch none of them."""
    found = []
    for text, more in zip(texts, tagged(model, texts)):
        own = base(text)
        every = list(own)
        for s in more:
            if all(s[2] <= a or b <= s[0] for a, _, b in every):
                every.append(s)
        found.append((own, sorted(every)))
    return found


def _found(batch: pa.RecordBatch, model: Tagger) -> tuple[list[str], list[tuple[list, list]]]:
    """All rows' texts and spans; equal texts of a batch are read once."""
    data, offsets = utf8(batch.column("text"))
    raw = memoryview(data)
    texts = [bytes(raw[a:b]).decode("utf-8", "replace") for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
    kinds = list(dict.fromkeys(texts))
    known = dict(zip(kinds, spans_of(model, kinds)))
    return texts, [known[t] for t in texts]


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _weights(model: Tagger) -> dict[str, np.ndarray]:
    return model.w


def find(docs: DataFrame, text: str = "text", model: Tagger | None = None) -> DataFrame:
    """Per row of ``docs``: doc_id, base counts by kind, base_spans and spans.

    Spans read kind:start:end (code points, end exclusive), by start and then
    kind. A null text counts as empty and has none. Rows are judged one by one
    by their whole texts, so rows that repeat get equal spans and an empty table
    gives none; only doc_id and the text are read, so columns cannot clash.
    """
    shared = docs.sparkSession.sparkContext.broadcast(_weights(model or fitted()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(shared.value)
        for batch in batches:
            _, found = _found(batch, tagger)
            counts = [pa.array([sum(s[1] == k for s in own) for own, _ in found], pa.int64()) for k in range(len(KINDS))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *counts, pa.array([_joined(own) for own, _ in found], pa.string()), pa.array([_joined(every) for _, every in found], pa.string())],
                names=["doc_id", *(f"n_{k}" for k in KINDS), "base_spans", "spans"],
            )

    schema = "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_spans string, spans string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(lean(run), schema)


def digests(docs: DataFrame, text: str = "text") -> DataFrame:
    found = find(docs, text)
    return found.select("doc_id", *(f"n_{k}" for k in KINDS), F.sha2("base_spans", 256).alias("base_sha256"), "spans")


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with every span replaced by its kind; of spans that overlap the first names all."""
    out, at = [], 0
    for a, k, b in spans:
        if a >= at:
            out += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, text: str = "text", model: Tagger | None = None) -> DataFrame:
    """``docs`` with the personal data in ``text`` replaced; other columns, whatever their names, and null texts stay."""
    shared = docs.sparkSession.sparkContext.broadcast(_weights(model or fitted()))
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(shared.value)
        for batch in batches:
            old = batch.column(place)
            texts, found = _found(pa.RecordBatch.from_arrays([old], names=["text"]), tagger)
            changed = [i for i, (_, every) in enumerate(found) if every]
            if changed:
                new = pa.array([masked(texts[i], found[i][1]) for i in changed], old.type)
                flags = np.zeros(len(old), bool)
                flags[changed] = True
                old = pc.replace_with_mask(old, pa.array(flags), new)
            columns = list(batch.columns)
            columns[place] = old
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(lean(run), docs.schema)


if __name__ == "__main__":
    np.savez_compressed(os.path.join(os.path.dirname(os.path.abspath(__file__)), "pii_weights.npz"), **train().w)
