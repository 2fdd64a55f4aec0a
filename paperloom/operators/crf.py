"""Linear-chain conditional random fields: feature templates, training, best path and marginals, in numpy.

A sequence is a list of rows of feature strings. Training batches all sequences: each step of forward and backward sums
runs over all sequences at once. Decoding in Spark is one Arrow pass per partition, with no shuffle.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np

#: Rows that are labelled side by side
ROWS = 1 << 14
ITEM = re.compile(r"%x\[(-?\d+),(\d+)\]")


def parse_template(text: str) -> tuple[list[tuple[str, list[tuple[int, int]]]], bool]:
    """Unigram templates as (name, [(row offset, column), ...]), and whether label bigrams are wanted."""
    out, bigram = [], False
    for line in text.splitlines():
        line = line.split("#")[0].strip()
        if line.startswith("U"):
            name, _, body = line.partition(":")
            out.append((name, [(int(a), int(b)) for a, b in ITEM.findall(body)]))
        elif line.startswith("B"):
            bigram = True
    return out, bigram


def expand(rows: list, templates) -> list[list[str]]:
    """Feature strings of each row."""
    n = len(rows)
    get = lambda i, c: rows[i][c] if 0 <= i < n else f"_B{i if i < 0 else i - n + 1:+d}"
    return [[f"{name}:" + "/".join(str(get(i + o, c)) for o, c in items) for name, items in templates] for i in range(n)]


@dataclass
class Model:
    template: str
    labels: list[str]
    index: dict[str, int] = field(repr=False)
    unary: np.ndarray = field(repr=False)
    pairs: np.ndarray = field(repr=False)

    def emissions(self, rows: list) -> np.ndarray:
        templates, _ = parse_template(self.template)
        out = np.zeros((len(rows), len(self.labels)))
        for i, fs in enumerate(expand(rows, templates)):
            ids = [self.index[f] for f in fs if f in self.index]
            if ids:
                out[i] = self.unary[ids].sum(axis=0)
        return out

    def best(self, rows: list) -> list[str]:
        """Viterbi; ties go to the first label."""
        if not rows:
            return []
        e = self.emissions(rows)
        score, back = e[0], []
        for x in e[1:]:
            s = score[:, None] + self.pairs
            back.append(s.argmax(axis=0))
            score = s.max(axis=0) + x
        path = [int(score.argmax())]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        return [self.labels[k] for k in reversed(path)]

    def marginals(self, rows: list) -> np.ndarray:
        """P(label) at each row."""
        if not rows:
            return np.zeros((0, len(self.labels)))
        e = self.emissions(rows)
        f, b = np.zeros_like(e), np.zeros_like(e)
        f[0] = e[0]
        for i in range(1, len(e)):
            f[i] = _lse(f[i - 1][:, None] + self.pairs, 0) + e[i]
        for i in range(len(e) - 2, -1, -1):
            b[i] = _lse(self.pairs + (e[i + 1] + b[i + 1])[None, :], 1)
        p = f + b
        p = np.exp(p - p.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)

    def label(self, rows: list) -> tuple[list[str], list[float]]:
        """Best path and each label's marginal."""
        best, p = self.best(rows), self.marginals(rows)
        at = {x: k for k, x in enumerate(self.labels)}
        return best, [float(p[i, at[x]]) for i, x in enumerate(best)]

    def label_all(self, sequences: list, confident: bool = True) -> list[tuple[list[str], list[float]]]:
        """label() of many sequences at once, to the last bit; without confident the marginals are left out as 0. Sequences
        of about equal length are done side by side, at most ROWS rows of them unless one is longer."""
        out: list = [([], [])] * len(sequences)
        order = sorted((k for k, s in enumerate(sequences) if s), key=lambda k: -len(sequences[k]))
        unary = np.vstack([self.unary.reshape(-1, len(self.labels)), np.zeros((1, len(self.labels)))])
        while order:
            n = max(1, ROWS // len(sequences[order[0]]))
            some, order = order[:n], order[n:]
            for k, x in zip(some, self._side_by_side([sequences[k] for k in some], unary, confident)):
                out[k] = x
        return out

    def _lookups(self) -> list[tuple[list[tuple[int, int]], dict[str, int]]]:
        """Of each template its items, and from what stands in its features to their numbers."""
        if "_by_template" not in self.__dict__:
            templates, _ = parse_template(self.template)
            by: dict[str, dict[str, int]] = {name: {} for name, _ in templates}
            for f, i in self.index.items():
                name, _, value = f.partition(":")
                by[name][value] = i
            self._by_template = [(items, by[name]) for name, items in templates]
        return self._by_template

    def _side_by_side(self, sequences: list, unary: np.ndarray, confident: bool) -> list[tuple[list[str], list[float]]]:
        """sequences: longest first. unary: with a row of zeros at the end, for unknown features."""
        lookups, k, none = self._lookups(), len(self.labels), len(unary) - 1
        reach = max((abs(o) for items, _ in lookups for o, _ in items), default=0)
        sizes = np.array([len(s) for s in sequences])
        ids: list[list[int]] = [[] for _ in lookups]
        for rows in sequences:
            n = len(rows)
            before, behind = [f"_B{i:+d}" for i in range(-reach, 0)], [f"_B{i:+d}" for i in range(1, reach + 1)]
            columns: dict[int, list[str]] = {}
            for (items, known), mine in zip(lookups, ids):
                parts = []
                for o, c in items:
                    if c not in columns:
                        columns[c] = [*before, *(str(r[c]) for r in rows), *behind]
                    parts.append(columns[c][reach + o : reach + o + n])
                mine += [known.get(v, none) for v in (parts[0] if len(parts) == 1 else map("/".join, zip(*parts)) if parts else [""] * n)]
        flat = np.zeros((int(sizes.sum()), k))
        for mine in ids:
            flat += unary[mine]
        starts = np.cumsum(sizes) - sizes
        longest, live = int(sizes[0]), [int((sizes > t).sum()) for t in range(int(sizes[0]))]
        e = np.zeros((longest, len(sequences), k))
        for t, a in enumerate(live):
            e[t, :a] = flat[starts[:a] + t]
        score, back = e[0].copy(), np.zeros((longest, len(sequences), k), np.int32)
        for t in range(1, longest):
            a = live[t]
            s = score[:a, :, None] + self.pairs
            back[t, :a] = s.argmax(axis=1)
            score[:a] = s.max(axis=1) + e[t, :a]
        path = np.zeros((longest, len(sequences)), np.int32)
        all_, last = np.arange(len(sequences)), score.argmax(axis=1)
        path[sizes - 1, all_] = last
        for t in range(longest - 1, 0, -1):
            a = live[t]
            path[t - 1, :a] = back[t, all_[:a], path[t, :a]]
        p = self._all_marginals(e, live) if confident else None
        out = []
        for j, n in enumerate(sizes):
            best = path[:n, j]
            out.append(([self.labels[y] for y in best], [0.0] * n if p is None else p[np.arange(n), j, best].tolist()))
        return out

    def _all_marginals(self, e: np.ndarray, live: list[int]) -> np.ndarray:
        f, b = np.zeros_like(e), np.zeros_like(e)
        f[0] = e[0]
        for t in range(1, len(e)):
            a = live[t]
            f[t, :a] = _lse(f[t - 1, :a, :, None] + self.pairs, 1) + e[t, :a]
        for t in range(len(e) - 2, -1, -1):
            a = live[t + 1]
            b[t, :a] = _lse(self.pairs + (e[t + 1, :a] + b[t + 1, :a])[:, None, :], 2)
        p = f + b
        p = np.exp(p - p.max(axis=2, keepdims=True))
        return p / p.sum(axis=2, keepdims=True)


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return np.squeeze(m, axis) + np.log(np.exp(x - m).sum(axis=axis))


def train(sequences: list[tuple[list, list[str]]], template: str, least: int = 1, cost: float = 3.0, steps: int = 60) -> Model:
    """sequences: (rows, labels). least: features seen less often are dropped; cost: inverse of the penalty on weights."""
    templates, bigram = parse_template(template)
    sequences = [s for s in sequences if s[0]]
    labels = sorted({y for _, ys in sequences for y in ys})
    feats = [expand(rows, templates) for rows, _ in sequences]
    count = Counter(f for seq in feats for fs in seq for f in fs)
    index = {f: i for i, f in enumerate(sorted(f for f, n in count.items() if n >= least))}
    k, n, longest = len(labels), len(sequences), max((len(s) for s in feats), default=0)
    model = Model(template, labels, index, np.zeros((len(index), k)), np.zeros((k, k)))
    if not n or k < 2:
        return model
    at = {y: i for i, y in enumerate(labels)}
    y = np.full((n, longest), -1)
    where, ids = [], []
    for s, (seq, (_, ys)) in enumerate(zip(feats, sequences)):
        y[s, : len(ys)] = [at[v] for v in ys]
        for t, fs in enumerate(seq):
            mine = [index[f] for f in fs if f in index]
            where += [s * longest + t] * len(mine)
            ids += mine
    where, ids = np.array(where), np.array(ids)
    order = np.argsort(ids, kind="stable")
    by_where, by_ids = where[order], ids[order]
    heads = np.flatnonzero(np.diff(by_ids, prepend=-1))
    starts = np.flatnonzero(np.diff(where, prepend=-1))
    mask = y >= 0
    gold = np.zeros((n, longest, k))
    gold[np.nonzero(mask)[0], np.nonzero(mask)[1], y[mask]] = 1
    gold_pairs = np.zeros((k, k))
    both = mask[:, 1:]
    np.add.at(gold_pairs, (y[:, :-1][both], y[:, 1:][both]), 1)

    def loss(theta):
        unary, pairs = theta[: len(index) * k].reshape(-1, k), theta[len(index) * k :].reshape(k, k)
        e = np.zeros((n * longest, k))
        if len(ids):
            e[where[starts]] = np.add.reduceat(unary[ids], starts)
        e = e.reshape(n, longest, k)
        f, b = np.zeros_like(e), np.zeros_like(e)
        f[:, 0] = e[:, 0]
        for t in range(1, longest):
            f[:, t] = np.where(mask[:, t, None], _lse(f[:, t - 1][:, :, None] + pairs[None], 1) + e[:, t], f[:, t - 1])
        z = _lse(f[:, -1], 1)
        for t in range(longest - 2, -1, -1):
            b[:, t] = np.where(mask[:, t + 1, None], _lse(pairs[None] + (e[:, t + 1] + b[:, t + 1])[:, None, :], 2), b[:, t + 1])
        p = np.exp(f + b - z[:, None, None]) * mask[:, :, None]
        q = np.zeros((k, k))
        for t in range(1, longest):
            m = mask[:, t]
            q += np.exp(f[m, t - 1][:, :, None] + pairs[None] + (e[m, t] + b[m, t])[:, None, :] - z[m][:, None, None]).sum(axis=0)
        value = z.sum() - (e * gold).sum() - (pairs * gold_pairs).sum() + theta @ theta / (2 * cost)
        g = np.zeros((len(index), k))
        diff = (p - gold).reshape(-1, k)
        if len(ids):
            g[by_ids[heads]] = np.add.reduceat(diff[by_where], heads)
        gp = q - gold_pairs if bigram else np.zeros((k, k))
        return value, np.concatenate([g.ravel(), gp.ravel()]) + theta / cost

    theta = _lbfgs(loss, np.zeros(len(index) * k + k * k), steps)
    model.unary, model.pairs = theta[: len(index) * k].reshape(-1, k), theta[len(index) * k :].reshape(k, k)
    return model


def _lbfgs(loss, x: np.ndarray, steps: int, memory: int = 8) -> np.ndarray:
    value, g = loss(x)
    s, y = [], []
    for _ in range(steps):
        d = -g
        a = []
        for u, v in zip(reversed(s), reversed(y)):
            a.append((u @ d) / (u @ v))
            d = d - a[-1] * v
        if s:
            d = d * (s[-1] @ y[-1]) / (y[-1] @ y[-1])
        for (u, v), w in zip(zip(s, y), reversed(a)):
            d = d + u * (w - (v @ d) / (u @ v))
        step, slope = (1.0 if s else 1.0 / max(1.0, np.abs(g).sum())), g @ d
        for _ in range(25):
            new, ng = loss(x + step * d)
            if new <= value + 1e-4 * step * slope:
                break
            step /= 2
        else:
            break
        u, v = step * d, ng - g
        if u @ v > 1e-10:
            s, y = [*s, u][-memory:], [*y, v][-memory:]
        done = abs(value - new) < 1e-5 * max(1.0, abs(value))
        x, value, g = x + u, new, ng
        if done:
            break
    return x
