"""Scoring documents for abusive, threatening, hateful or sexually explicit language."""

from __future__ import annotations

import pickle
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.sources.tables import spread

#: Words of a window; words read before and behind it, so that states know them; words of a piece that is read at once.
WINDOW, CONTEXT, SEGMENT = 24, 8, 256
#: Width of word vectors and of each direction's state; rows of the two tables of vectors; bound of attention's exponents.
WIDTH, STATE, ROWS, LIMIT = 16, 12, 1 << 14, 8.0
#: Labelled documents that are read for training at most.
MAX_LABELLED = 4000
#: Score from which a document counts as abusive. Labels favour abusive documents about sixfold, so what the network takes for even
#: odds has odds of one to six in the corpus; a logit of 1.9, a score of 0.87, makes up for that.
THRESHOLD = 0.87
#: Logit under which a harmless text needn't be learnt again; logit that a text labelled abusive has to reach, and one that a text labelled
#: harmless may not, once half of the rounds are over.
SETTLED, ABUSIVE, HARMLESS = -3.0, 1.0, 4.0
#: Windows of a step of training, and steps of a round at least.
BATCH, STEPS = 64, 30

#: Marks before a word that was disguised: letters masked, spelt out or look-alikes, drawn out.
MASKED, LOOKALIKE, STRETCHED = "\x01", "\x02", "\x03"

_INVISIBLE = re.compile("[\xad\u200b-\u200f\u2060-\u2064\ufeff]+")
_UNSEEN = "".join(c for c in map(chr, range(0x10000)) if _INVISIBLE.match(c))
_SPELT = re.compile(r"(?<![^\W_])(?:[^\W_](?:\.| |-|_|\*| \. )){2,}[^\W_](?![^\W_])")
_TOKEN = re.compile(r"\x02?[$@]?\w[\w$@*!]*")
_PARTED = re.compile(r"(?:[^\W_][*_])+[^\W_][*_]?")
_AROUND = ".,;:!?()[]{}\"'»«„“”‘’…–—-/|"
_REPEATED = re.compile(r"(\w)\1{2,}")
#: Look-alike signs and letters.
_LOOKALIKE = str.maketrans("013457$@!", "oieastsai")
_HOMOGLYPH = str.maketrans("аеорсухіјѕԁοαερ", "aeopcyxijsdoaep")
_FOREIGN = re.compile("[аеорсухіјѕԁοαερ]")


class Reader(dict):
    """Rows of the words of texts; the dict holds the row of each token met before, `words` the word of each row."""

    def __init__(self, known: frozenset[str]) -> None:
        super().__init__()
        self.known, self.words, self.single = known, [""], [False]  # row 0 is padding
        self.parts: dict[str, list[int]] = {}  # rows of what stands between blanks
        self.number = [self["0"]]

    def canonical(self, token: str) -> str:
        """Numbers and codes as one word each; disguised words as what they spell, after a character that tells how it was disguised."""
        form = token[0] if token[0] < "\x04" else ""
        token = token[len(form) :]
        if token.isalpha():
            short = _REPEATED.sub(r"\1", token)
            return (form or STRETCHED) + short if short != token else form + token
        token = token.rstrip("!@_").lstrip("_")
        if _PARTED.fullmatch(token):
            token, form = re.sub(r"[*_]", "", token), LOOKALIKE
        if token.isalpha():
            return form + token
        if "*" in token:
            return MASKED + re.sub(r"\*+", "*", token)
        if token.strip("$@").isdigit() or not token:
            return "0"
        spelt = token.translate(_LOOKALIKE)
        if spelt not in self.known and "1" in token:
            spelt = token.replace("1", "l").translate(_LOOKALIKE)
        return LOOKALIKE + spelt if spelt in self.known else "0a"

    def __missing__(self, token: str) -> int:
        word = self.canonical(token)
        row = self.get(word) if word != token else None
        if row is None:
            row = len(self.words)
            self.words.append(word)
            self.single.append(len(token) == 1 and token.isalpha())
            self[word] = row
        self[token] = row
        return row

    def rows_of(self, text: str) -> list[int]:
        bare = text.strip(_AROUND)
        if bare.isdigit():
            return self.number
        if bare.isascii() and bare.isalnum():  # most are one word
            return [self[bare]]
        return [self[t] for t in _TOKEN.findall(_SPELT.sub(_put_together, plain(text)))]

    def read(self, texts: list[str | None] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(rows of all texts' words, number of words of each text). Letters spelt out one by one count as the word that they spell."""
        lower = pc.utf8_lower(pc.fill_null(pa.array(texts, pa.string()) if isinstance(texts, list) else texts, ""))
        parts = pc.utf8_split_whitespace(lower)
        coded = parts.flatten().dictionary_encode()
        each = []
        for part in coded.dictionary.to_pylist():  # each different run of characters once
            rows = self.parts.get(part)
            if rows is None:
                rows = self.rows_of(part)
                if rows is not self.number:
                    self.parts[part] = rows
            each.append(rows)
        flat, many = _joined(each)
        code = coded.indices.to_numpy()
        ends = np.concatenate([[0], np.cumsum(many[code])])
        flat = flat[np.arange(ends[-1]) + np.repeat((np.cumsum(many) - many)[code] - ends[:-1], many[code])]
        ends = ends[np.concatenate([[0], np.cumsum(parts.value_lengths().to_numpy())])]
        sizes = np.diff(ends)
        alone = np.array(self.single, bool)[flat]
        near = alone | (flat == self.number[0])
        run = np.flatnonzero(near[2:] & near[1:-1] & near[:-2] & (alone[2:].astype(int) + alone[1:-1] + alone[:-2] > 1))
        if len(run):  # letters with blanks between them
            rows = np.split(flat, ends[1:-1])
            for i in np.unique(np.searchsorted(ends[1:], run, "right")):
                rows[i] = np.array(self.rows_of(lower[i].as_py()), np.int64)
            flat, sizes = np.concatenate(rows), np.array([len(r) for r in rows], np.int64)
        return flat, sizes


def _put_together(m: re.Match) -> str:
    return LOOKALIKE + "".join(c for c in m.group() if c.isalnum()) if sum(c.isalpha() for c in m.group()) > 2 else m.group()


def plain(text: str) -> str:
    """Lower case, without invisible characters, with Latin letters in place of those that look like them."""
    text = text.lower()
    if not text.isascii():
        if any(c in text for c in _UNSEEN):
            text = _INVISIBLE.sub("", text)
        if _FOREIGN.search(text):
            text = re.sub(r"[^\W\d_]+", lambda m: m.group().translate(_HOMOGLYPH) if re.search("[a-z]", m.group()) else m.group(), text)
    return text


def features(word: str, known: frozenset[str]) -> tuple[int, list[int], int]:
    """(row of the word, 0 if training hasn't seen it; rows of all its runs of three characters; how it was disguised)."""
    form = ord(word[0]) if word[:1] and word[0] < "\x04" else 0
    word = word[form > 0 :]
    marked = f"<{word}>"
    grams = [zlib.crc32(marked[i : i + 3].encode()) % ROWS for i in range(max(1, len(marked) - 2))]
    return (1 + zlib.crc32(word.encode()) % (ROWS - 1) if word in known or word in ("0", "0a") else 0), grams, form


@dataclass
class Features:
    """Features of words as arrays; the grams of word i are gram[start[i]:start[i + 1]]."""

    word: np.ndarray
    gram: np.ndarray
    start: np.ndarray
    form: np.ndarray

    def of(self, rows: np.ndarray) -> Features:
        many = np.diff(self.start)[rows]
        ends = np.cumsum(many)
        at = np.arange(ends[-1]) + np.repeat(self.start[rows] - (ends - many), many)
        return Features(self.word[rows], self.gram[at], np.concatenate([[0], ends]), self.form[rows])


def stacked(words: list[str], known: frozenset[str]) -> Features:
    each = [features(w, known) for w in words]
    return Features(np.array([e[0] for e in each], np.int64), np.array([g for e in each for g in e[1]], np.int64), np.cumsum([0, *(len(e[1]) for e in each)]), np.array([e[2] for e in each], np.int64))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _soft(x: np.ndarray, room: np.ndarray) -> None:
    """x / (1 + |x|) in place, in a fifth of the time of a hyperbolic tangent."""
    np.abs(x, room)
    room += 1
    np.divide(x, room, x)


def _summed(values: np.ndarray, order: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Sums of the rows of each group; `order` puts groups together, `firsts` are their begins."""
    return np.add.reduceat(values[order], firsts, axis=0)


class Network:
    """Word and character vectors, a gated recurrent network in both directions, attention over a window, one output."""

    def __init__(self, seed: int = 1) -> None:
        rng = np.random.default_rng(seed)
        normal = lambda *s, by=1.0: (rng.standard_normal(s) * by).astype(np.float32)
        d, h = WIDTH, STATE
        self.p = {
            "word": normal(ROWS, d, by=0.1),
            "gram": normal(ROWS, d, by=0.3),
            "form": normal(4, d, by=0.3),
            **{f"w{k}": normal(d, 3 * h, by=d**-0.5) for k in "fb"},
            **{f"u{k}": normal(h, 3 * h, by=h**-0.5) for k in "fb"},
            **{f"b{k}": np.zeros(3 * h, np.float32) for k in "fb"},
            "attend": normal(2 * h, by=0.3),
            "out": normal(2 * h, by=0.3),
            "bias": np.full(1, -1.0, np.float32),
        }
        self.moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in self.p.items()}
        self.step = 0

    def vectors(self, feats: Features) -> np.ndarray:
        p, many = self.p, np.diff(feats.start)
        x = np.add.reduceat(p["gram"][feats.gram], feats.start[:-1], axis=0) / many[:, None] + p["form"][feats.form] + p["word"][feats.word]
        x[0] = 0  # padding
        return x.astype(np.float32)

    def gates(self, x: np.ndarray) -> dict[str, tuple[np.ndarray, np.ndarray]]:
        """What each word adds to the two gates and to the candidate of both directions; padding, row 0, leaves the state as it is."""
        out = {}
        for k in "fb":
            g = x @ self.p[f"w{k}"] + self.p[f"b{k}"]
            g[0, :STATE] = 1e9
            out[k] = np.ascontiguousarray(g[:, : 2 * STATE]), np.ascontiguousarray(g[:, 2 * STATE :])
        return out

    def _run(self, gates: tuple[np.ndarray, np.ndarray], steps: np.ndarray, k: str, tape: list | None = None) -> np.ndarray:
        """States of one direction; steps: steps x sequences, rows of words."""
        h, u = STATE, self.p[f"u{k}"]
        u, v = np.ascontiguousarray(u[:, : 2 * h]), np.ascontiguousarray(u[:, 2 * h :] * 0.5)
        n, m = steps.shape
        out = np.empty((n, m, h), np.float32)
        s, zr, c, part = np.zeros((m, h), np.float32), np.empty((m, 2 * h), np.float32), np.empty((m, h), np.float32), np.empty((m, h), np.float32)
        wide, size = np.empty((m, 2 * h), np.float32), np.empty((m, h), np.float32)
        for t in range(n) if k == "f" else range(n - 1, -1, -1):
            np.take(gates[0], steps[t], 0, zr, "clip")
            np.matmul(s, u, wide)
            zr += wide
            _soft(zr, wide)
            zr += 1  # twice the gates
            np.take(gates[1], steps[t], 0, c, "clip")
            np.matmul(s, v, part)
            if tape is not None:
                tape.append((t, s, zr[:, :h] * 0.5, zr[:, h:] * 0.5, c, part * 2))
            part *= zr[:, h:]
            c += part
            _soft(c, size)
            new = out[t]
            np.subtract(s, c, new)
            new *= zr[:, :h]
            new *= 0.5
            new += c
            s = new
            if tape is not None:
                c = np.empty_like(c)  # the tape keeps the one before
        return out

    def forward(self, index: np.ndarray, gates: dict[str, np.ndarray], tapes: dict[str, list] | None = None):
        """Logits of windows with their context (windows x (CONTEXT + WINDOW + CONTEXT) rows of the words)."""
        steps = index.T
        states = np.concatenate([self._run(gates[k], steps, k, tapes[k] if tapes else None) for k in "fb"], 2)[CONTEXT : CONTEXT + WINDOW]
        real = steps[CONTEXT : CONTEXT + WINDOW] > 0
        a = np.exp(np.clip(states @ self.p["attend"], -LIMIT, LIMIT)) * real
        a /= np.maximum(a.sum(0), 1e-9)
        context = np.einsum("tm,tmh->mh", a, states)
        logit = context @ self.p["out"] + self.p["bias"]
        return (logit, states, a, context) if tapes else logit

    def train_step(self, index: np.ndarray, feats: Features, target: np.ndarray, weight: np.ndarray, rate: float, unseen: np.ndarray | None = None) -> float:
        """One step of Adam on windows; `unseen` are words that are to be read as ones that training hasn't seen."""
        p, h = self.p, STATE
        rows, local = np.unique(index, return_inverse=True)
        local = local.reshape(index.shape)
        if rows[0] != 0:
            rows, local = np.concatenate([[0], rows]), local + 1
        own = feats.of(rows)
        if unseen is not None:
            own.word[unseen[rows]] = 0
        x = self.vectors(own)
        tapes: dict[str, list] = {"f": [], "b": []}
        logit, states, a, context = self.forward(local, self.gates(x), tapes)
        prob = _sigmoid(logit)
        loss = -float(np.mean(weight * (target * np.log(prob + 1e-7) + (1 - target) * np.log(1 - prob + 1e-7))))
        dlogit = (weight * (prob - target) / len(target)).astype(np.float32)
        grad = {"out": context.T @ dlogit, "bias": np.array([dlogit.sum()], np.float32)}
        dcontext = dlogit[:, None] * p["out"]
        da = np.einsum("mh,tmh->tm", dcontext, states)
        de = a * (da - (a * da).sum(0))
        grad["attend"] = np.einsum("tm,tmh->h", de, states)
        inner = a[:, :, None] * dcontext + de[:, :, None] * p["attend"]
        dx = np.zeros_like(x)
        flat = local.T.reshape(-1)
        order = np.argsort(flat, kind="stable")
        there, firsts = np.unique(flat[order], return_index=True)
        none = np.zeros((len(index), h), np.float32)
        for k, part in (("f", slice(0, h)), ("b", slice(h, 2 * h))):
            u = p[f"u{k}"]
            du = np.zeros_like(u)
            dgates = np.empty((index.shape[1], len(index), 3 * h), np.float32)
            ds = none
            for t, s, z, r, c, su in reversed(tapes[k]):
                if CONTEXT <= t < CONTEXT + WINDOW:
                    ds = ds + inner[t - CONTEXT][:, part]
                dc = ds * (1 - z) * np.square(1 - np.abs(c))
                dz = ds * (s - c) * 2 * np.square(np.minimum(z, 1 - z))
                dr = dc * su * 2 * np.square(np.minimum(r, 1 - r))
                dgates[t] = np.concatenate([dz, dr, dc], 1)
                through = np.concatenate([dz, dr, dc * r], 1)
                du += s.T @ through
                ds = ds * z + through @ u.T
            grad[f"u{k}"] = du
            total = np.zeros((len(x), 3 * h), np.float32)
            total[there] = _summed(dgates.reshape(-1, 3 * h), order, firsts)
            total[0] = 0  # padding learns nothing
            grad[f"w{k}"], grad[f"b{k}"] = x.T @ total, total.sum(0)
            dx += total @ p[f"w{k}"].T
        dx[0] = 0
        grad["form"] = np.zeros_like(p["form"])
        np.add.at(grad["form"], own.form[1:], dx[1:])
        self.step += 1
        for name, g in grad.items():
            self._adam(name, slice(None), g, rate)
        many = np.diff(own.start)
        for name, at, g in (("word", own.word[1:], dx[1:]), ("gram", own.gram, np.repeat(dx / many[:, None], many, axis=0))):
            touched, where = np.unique(at, return_inverse=True)
            order = np.argsort(where, kind="stable")
            self._adam(name, touched, _summed(g, order, np.searchsorted(where[order], np.arange(len(touched)))), rate)
        return loss

    def _adam(self, name: str, at, g: np.ndarray, rate: float) -> None:
        m, v = self.moments[name]
        m[at] = 0.9 * m[at] + 0.1 * g
        v[at] = 0.99 * v[at] + 0.01 * g * g
        scale = np.sqrt(v[at] / (1 - 0.99**self.step)) + 1e-6
        self.p[name][at] -= rate * (m[at] / (1 - 0.9**self.step)) / scale

    def every_window(self, flat: np.ndarray, sizes: np.ndarray, gates: dict[str, np.ndarray], block: int = 512) -> tuple[np.ndarray, np.ndarray]:
        """Logits of the windows at every word of texts, and the begin of each text's; `flat` holds the rows of all texts' words, `sizes` their numbers.

        A text of up to WINDOW words has one window, one without words has that too, of padding. States run over pieces of
        SEGMENT words with CONTEXT words before and behind; attention then pools the states of each window.
        """
        ends = np.cumsum(sizes)
        begins = ends - sizes
        pieces = np.maximum(1, -(-sizes // SEGMENT))
        owner = np.repeat(np.arange(len(sizes)), pieces)
        core = begins[owner] + SEGMENT * (np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
        stop = np.minimum(core + SEGMENT, ends[owner])
        low, high = np.maximum(core - CONTEXT, begins[owner]), np.minimum(stop + CONTEXT, ends[owner])
        heads = np.stack([self.p["attend"], self.p["out"]], 1)
        e, v = np.zeros(len(flat), np.float32), np.zeros(len(flat), np.float32)
        for some in np.array_split(o := np.argsort(high - low, kind="stable"), max(1, -(-len(o) // block))):
            at = low[some] + np.arange((high - low)[some].max(initial=0))[:, None]
            inside = at < high[some]
            steps = np.where(inside, flat[np.where(inside, at, 0)], 0) if len(flat) else np.zeros(at.shape, np.int64)
            both = sum(self._run(gates[k], steps, k) @ heads[i * STATE : (i + 1) * STATE] for i, k in enumerate("fb"))
            own = (at >= core[some]) & (at < stop[some])
            e[at[own]], v[at[own]] = both[..., 0][own], both[..., 1][own]
        many = np.maximum(1, sizes - WINDOW + 1)
        room = np.maximum(sizes, WINDOW)
        place = np.arange(len(flat)) + np.repeat((np.cumsum(room) - room) - begins, sizes)
        a, av = np.zeros(int(room.sum()), np.float32), np.zeros(int(room.sum()), np.float32)
        a[place] = np.exp(np.clip(e, -LIMIT, LIMIT)) * (flat > 0)
        av[place] = a[place] * v
        n = len(a) - WINDOW + 1
        sa, sav = sum(a[k : k + n] for k in range(WINDOW)), sum(av[k : k + n] for k in range(WINDOW))
        firsts = np.cumsum(many) - many
        starts = np.arange(int(many.sum())) + np.repeat((np.cumsum(room) - room) - firsts, many)
        return (sav[starts] / np.maximum(sa[starts], 1e-9) + self.p["bias"]).astype(np.float32), firsts


def _joined(texts: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(t) for t in texts], np.int64)
    return np.fromiter(chain.from_iterable(texts), np.int64, int(sizes.sum())), sizes


def _windows(flat: np.ndarray, low: np.ndarray, high: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The words from CONTEXT before each place to CONTEXT behind its window, within texts that go from low to high."""
    place = at[:, None] + np.arange(-CONTEXT, WINDOW + CONTEXT)
    inside = (place >= low[:, None]) & (place < high[:, None])
    return np.where(inside, flat[np.where(inside, place, 0)], 0)


@dataclass
class _Labelled:
    """Words of the labelled texts with what training needs of them."""

    flat: np.ndarray
    sizes: np.ndarray
    y: np.ndarray
    feats: Features
    blank: int

    def __post_init__(self) -> None:
        self.high = np.cumsum(self.sizes)
        self.low = self.high - self.sizes
        self.most = self.low + np.maximum(0, self.sizes - WINDOW)  # where each text's last window begins

    def part(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(words, sizes) of some of the texts."""
        sizes = self.sizes[docs]
        return self.flat[np.arange(int(sizes.sum())) + np.repeat(self.low[docs] - (np.cumsum(sizes) - sizes), sizes)], sizes

    def guessed(self) -> np.ndarray:
        """Where each text's window begins whose words are most those of texts labelled abusive."""
        n, docs = len(self.feats.word), len(self.sizes)
        code = np.unique(np.repeat(np.arange(docs), self.sizes) * n + self.flat)
        seen = np.stack([np.bincount(code[self.y[code // n] == label] % n, minlength=n) for label in (False, True)])
        odds = np.log((seen[1] + 0.3) / (self.y.sum() + 1)) - np.log((seen[0] + 0.3) / ((~self.y).sum() + 1))
        total = np.concatenate([[0], np.cumsum((np.clip(odds, 0, 4) ** 2 * (seen.sum(0) > 1))[self.flat])])
        best = np.empty(docs, np.int64)
        for i, (low, high, most) in enumerate(zip(self.low, self.high, self.most)):
            best[i] = low + (total[np.minimum(np.arange(low, most + 1) + WINDOW, high)] - total[low : most + 1]).argmax()
        return best

    def scored(self, network: Network, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(highest logit of each text, where its window begins)."""
        flat, sizes = self.part(docs)
        logit, firsts = network.every_window(flat, sizes, network.gates(network.vectors(self.feats)))
        top = np.maximum.reduceat(logit, firsts)
        owner = np.repeat(np.arange(len(docs)), np.diff(np.append(firsts, len(logit))))
        at = np.flatnonzero(logit >= top[owner])
        where = np.zeros(len(docs), np.int64)
        where[owner[at][::-1]] = (at - firsts[owner[at]])[::-1]  # the first of equal ones
        return top, self.low[docs] + where


def _fit(network: Network, data: _Labelled, rounds: int, rng: np.random.Generator) -> None:
    """Rounds of learning, with its label, the window that scores highest in each text, which a label is most likely about.

    At first windows are guessed. Later on harmless texts are scored at every word, and those whose highest window isn't
    settled yet are learnt, so what only looks abusive is learnt as often as what is. A few labels are wrong: once
    half of the rounds are over, texts whose score contradicts their label are left out of each round.
    """
    y = data.y
    every = np.arange(len(y))
    at, logit = data.guessed(), np.where(y, 0, -9).astype(np.float32)
    logit[rng.permutation(np.flatnonzero(~y))[: 2 * y.sum()]] = 0
    for e in range(rounds):
        if e > 0:
            some = every if e in (1, 3, rounds - 2) else np.flatnonzero(y | (logit > SETTLED))
            logit[some], at[some] = data.scored(network, some)
        late = 2 * e >= rounds
        mine = np.flatnonzero(y & ((logit > ABUSIVE) | (not late)))
        if 2 * len(mine) < y.sum():  # too little is learnt yet to tell which labels are wrong
            mine = np.flatnonzero(y)
        tough = np.flatnonzero(~y & (logit > SETTLED) & ((logit < HARMLESS) | (not late)))
        steps = 0
        while steps < STEPS:  # few windows are learnt more often in a round
            other = rng.permutation(np.flatnonzero(~y))[: len(mine)]
            owner = np.concatenate([mine, mine, tough, other])
            label = (np.arange(len(owner)) < 2 * len(mine)).astype(np.float32)
            weight = np.where(label > 0, 0.5, 1).astype(np.float32)
            shifted = np.clip(at[owner] + rng.integers(-8, 9, len(owner)), data.low[owner], data.most[owner])
            anywhere = data.low[owner] + (rng.random(len(owner)) * (data.most[owner] - data.low[owner] + 1)).astype(np.int64)
            place = np.arange(len(owner))
            begin = np.where(place < len(mine), shifted, np.where(place < len(owner) - len(other), at[owner], anywhere))
            index = _windows(data.flat, data.low[owner], data.high[owner], begin)
            index[(rng.random(index.shape) < 0.03) & (index > 0)] = data.blank
            order = rng.permutation(len(index))
            for i in range(0, len(order), BATCH):
                b = order[i : i + BATCH]
                network.train_step(index[b], data.feats, label[b], weight[b], 0.01 * (1 - 0.8 * e / max(1, rounds - 1)), rng.random(len(data.feats.word)) < 0.15)
                steps += 1


def train(labelled: list[tuple[str, int]], seed: int = 1, rounds: int = 8) -> tuple[Network, frozenset[str]]:
    """A network from documents with labels, and the words it knows: those that at least two of the documents have."""
    rng = np.random.default_rng(seed)
    texts = [text for text, _ in labelled]
    reader = Reader(frozenset())
    flat, sizes = reader.read(texts)
    seen = np.unique(np.repeat(np.arange(len(sizes)), sizes) * len(reader.words) + flat) % max(1, len(reader.words))
    many = np.bincount(seen, minlength=len(reader.words))
    reader = Reader(frozenset(w for w, n in zip(reader.words, many) if n > 1 and w.isalpha()))
    blank = reader["0a"]
    flat, sizes = reader.read(texts)
    data = _Labelled(flat, sizes, np.array([bool(label) for _, label in labelled], bool), stacked(reader.words, reader.known), blank)
    network = Network(seed)
    if data.y.any() and not data.y.all():
        _fit(network, data, rounds, rng)
    return network, reader.known


class Scorer:
    """Scores whole texts by their most abusive window; remembers the words' part of the network."""

    def __init__(self, network: Network, known: frozenset[str]) -> None:
        self.network, self.known = network, known
        self._fresh()

    def _fresh(self) -> None:
        self.reader = Reader(self.known)
        self.gates = self.network.gates(np.zeros((1, WIDTH), np.float32))
        self.have = 1

    def __call__(self, texts: list[str | None] | pa.Array) -> np.ndarray:
        if self.have > 100_000 or len(self.reader.parts) > 300_000:
            self._fresh()
        flat, sizes = self.reader.read(texts)
        many = len(self.reader.words)
        if many > self.have:
            new = self.network.gates(self.network.vectors(stacked(["", *self.reader.words[self.have :]], self.known)))
            if many > len(self.gates["f"][0]):
                self.gates = {k: tuple(np.concatenate([t[: self.have], np.empty((many, t.shape[1]), np.float32)]) for t in v) for k, v in self.gates.items()}
            for k, tables in self.gates.items():
                for own, more in zip(tables, new[k]):
                    own[self.have : many] = more[1:]
            self.have = many
        logit, firsts = self.network.every_window(flat, sizes, self.gates)
        return np.where(sizes > 0, _sigmoid(np.maximum.reduceat(logit, firsts)), 0.0)


@dataclass
class Model:
    """A trained network and the words it knows; plain arrays, so that it can be stored and loaded."""

    network: Network
    known: frozenset[str]

    def save(self, path: str) -> None:
        with open(path, "wb") as f:
            f.write(self.to_bytes())

    def to_bytes(self) -> bytes:
        return pickle.dumps((self.network.p, sorted(self.known)))

    @staticmethod
    def from_bytes(data: bytes) -> Model:
        network = Network.__new__(Network)
        network.p, known = pickle.loads(data)  # written by to_bytes
        return Model(network, frozenset(known))

    @staticmethod
    def load(path: str) -> Model:
        with open(path, "rb") as f:
            return Model.from_bytes(f.read())


def _labelled(documents: DataFrame, labels: DataFrame, limit: int) -> list[tuple[str, int]]:
    """Texts with the reviewers' majority label, at most `limit`, chosen by a hash of doc_id; ties and nulls give no label."""
    votes = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").select("doc_id", "reviewer", "toxic").distinct()
    voted = votes.groupBy("doc_id").agg(F.sum(F.when(F.col("toxic") == 1, 1).otherwise(-1)).alias("s")).where("s <> 0")
    chosen = voted.orderBy((F.col("s") < 0).cast("int"), F.xxhash64("doc_id")).limit(limit // 3).unionByName(voted.where("s < 0").orderBy(F.xxhash64("doc_id")).limit(limit - limit // 3)).distinct()
    rows = documents.where(F.length("text") > 0).select("doc_id", "text").join(F.broadcast(chosen), "doc_id").orderBy("doc_id").collect()  # at most limit rows
    return [(r["text"], int(r["s"] > 0)) for r in rows]


def fitted(documents: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Model:
    """A model trained on at most `max_labelled` labelled documents of these tables, a third of them at most abusive."""
    return Model(*train(_labelled(documents, labels, max_labelled)))


def scored(documents: DataFrame, labels: DataFrame | None = None, max_labelled: int = MAX_LABELLED, model: Model | None = None) -> DataFrame:
    """`doc_id, source, score` of every row; score is 0 to 1, of the most abusive window.

    The score comes from `model`, else from one that is trained with `labels`. A gated recurrent network reads each text in both
    directions; words come as their own vector, the vectors of all their runs of three characters, and how they were
    disguised (look-alike signs, letters spelt out, masked or drawn out, invisible characters). Attention pools the states of each window of
    WINDOW words; windows begin at every word, over the whole of every text. No list of words takes part. Null and empty texts
    and texts without a word have score 0. Repeated rows come out repeated. With labels of one kind only nothing can be
    learnt and the scores mean nothing; an empty table gives no row.
    """
    model = model or fitted(documents, labels, max_labelled)
    shared = documents.sparkSession.sparkContext.broadcast(model.to_bytes())  # two tables of ROWS vectors and the labelled texts' words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = _scorer_of(shared)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("source"), pa.array(score(part.column("text")).astype(np.float64))], names=["doc_id", "source", "score"])

    return spread(documents.selectExpr("cast(doc_id AS BIGINT) AS doc_id", "source", "text")).mapInArrow(run, "doc_id long, source string, score double")


_held: list = []


def _scorer_of(shared) -> Scorer:
    """One scorer for each worker process, so that words it has looked up serve the next tasks."""
    if not _held or _held[0] is not shared.value:
        model = Model.from_bytes(shared.value)
        _held[:] = [shared.value, Scorer(model.network, model.known)]
    return _held[1]


def abusive(documents: DataFrame, labels: DataFrame | None = None, threshold: float = THRESHOLD, model: Model | None = None) -> DataFrame:
    """Documents whose score reaches `threshold`: `doc_id`."""
    return scored(documents, labels, model=model).where(F.col("score") >= threshold).select("doc_id").where("doc_id IS NOT NULL").distinct()


def source_rates(documents: DataFrame, labels: DataFrame | None = None, threshold: float = THRESHOLD, model: Model | None = None) -> DataFrame:
    """`source, documents, abusive, rate, mean_score`; documents without source are one row with null source."""
    hit = (F.col("score") >= threshold).cast("long")
    return scored(documents, labels, model=model).groupBy("source").agg(F.count("*").alias("documents"), F.sum(hit).alias("abusive"), F.avg(hit).alias("rate"), F.avg("score").alias("mean_score"))
