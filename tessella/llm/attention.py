"""A causal self-attention model over subword ids, in numpy.

Inputs are the ids before each target.  A window has `context` ids that are only looked at and `scored` ids
whose successors are scored; windows of a document overlap by the context, so each of its ids is scored once.
Learning and scoring work on a stream of blocks, where a window is a block and the one before it: what depends on one id is looked up once for both.
Attention is causal, with a bias for each distance.  What it gathers is added to the embeddings of the last
two ids; from the hidden vector follow weights of `classes` latent classes, each of which is a distribution over the ids: the
probability of an id is the weighted sum of its probabilities in the classes, so no sum over the vocabulary is needed to score it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

START, END = 0, 1
CONTEXT, SCORED = 16, 16
DEPTH, HIDDEN, CLASSES = 4, 16, 16
#: Windows of a step and those of them that follow one another; how far a step goes, and the weight of what all classes give every id while they learn.
BATCH, STRETCH, RATE, LEAST = 512, 8, 0.2, 1e-4
#: The part of each class that is spread over all ids in the end, met or not.
FLOOR = 0.01
#: Windows that are scored together: their scores stay in the processor's cache.
TOGETHER = 384
#: Up to so many rows of an index are added together with those of others.
FEW = 24
#: exp() of less than this neither overflows in 32 bits nor does a window's sum of it.
SAFE = 60.0


def windows(ids: np.ndarray, lengths: np.ndarray, before: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(inputs (n, CONTEXT + SCORED), targets (n, SCORED), place (len(ids),)) of documents laid end to end.

    place says where each id stands among the flattened targets; what fills a document's last window is scored, but has no place.  before has the CONTEXT + 1
    ids that stand before each document; START marks if it is None.
    """
    held = -(-lengths // SCORED)
    size = held * SCORED + CONTEXT
    first, begins, at = (np.concatenate(([0], np.cumsum(x)))[:-1] for x in (lengths, size, held * SCORED))
    inside = np.arange(len(ids)) - np.repeat(first, lengths)
    buffer = np.full(int(size.sum()) + CONTEXT + 1, START, dtype=np.int32)
    buffer[np.repeat(begins, lengths) + CONTEXT + 1 + inside] = ids
    # a document's last id is no input; where a window ends with it, it has been written on the next document's first mark
    buffer[begins[:, None] + np.arange(CONTEXT + 1)] = START if before is None else before
    n = int(held.sum())
    start = np.repeat(begins - at, held) + np.arange(n) * SCORED
    inputs = np.lib.stride_tricks.sliding_window_view(buffer, CONTEXT + SCORED)[start] if n else np.zeros((0, CONTEXT + SCORED), np.int32)
    place = np.repeat(at, lengths) + inside
    targets = np.full(n * SCORED, START, dtype=np.int32)
    targets[place] = ids
    return inputs, targets.reshape(n, SCORED), place


def stream(ids: np.ndarray, lengths: np.ndarray, before: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(inputs, place (len(ids),)): documents laid end to end, each in whole blocks of SCORED behind a block of what stands before it.

    place says where each id stands; the input before it has it as its target.  before is as in windows().
    """
    size = (lengths // SCORED + 1) * SCORED + CONTEXT
    first, begins = (np.concatenate(([0], np.cumsum(x)))[:-1] for x in (lengths, size))
    place = np.arange(len(ids)) + np.repeat(begins - first + CONTEXT + 1, lengths)
    inputs = np.full(int(size.sum()), START, dtype=np.int32)
    inputs[place] = ids
    if before is not None:
        inputs[begins[:, None] + np.arange(CONTEXT + 1)] = before
    return inputs, place


def _paired(blocks: np.ndarray) -> np.ndarray:
    """Each block but the first of a stretch, behind the one before it: (stretches, n + 1, SCORED, width) to (stretches * n, 2 * SCORED, width)."""
    return np.concatenate((blocks[:, :-1], blocks[:, 1:]), axis=2).reshape(-1, CONTEXT + SCORED, blocks.shape[-1])


def _softmax(z: np.ndarray, allowed: np.ndarray | None = None) -> np.ndarray:
    """Of the last axis; where allowed is given, of those places alone."""
    if z.size and max(z.max(), -z.min()) > SAFE:
        z = z - z.max(axis=-1, keepdims=True)
    z = np.exp(z)
    if allowed is not None:
        z *= allowed
    z /= (z @ np.ones(z.shape[-1], z.dtype))[..., None]
    return z


@dataclass
class Attention:
    """Weights by name: E, P (embeddings of the last id and the one before), Wq, Wk, Wv, Wo, R (by distance), b, O, c, T (ids in classes, as logits)."""

    weights: dict[str, np.ndarray]

    @classmethod
    def new(cls, counts: np.ndarray, depth: int = DEPTH, hidden: int = HIDDEN, classes: int = CLASSES, seed: int = 1) -> Attention:
        """counts: how often each id occurs; classes begin near these."""
        rng, m = np.random.default_rng(seed), len(counts)
        draw = lambda *s, by: (rng.standard_normal(s) * by).astype(np.float32)
        usual = np.log((counts + 0.1) / (counts + 0.1).sum()).astype(np.float32)
        return cls(
            {
                "E": draw(m, hidden, by=0.3), "P": draw(m, hidden, by=0.1), "Wq": draw(hidden, depth, by=0.2), "Wk": draw(hidden, depth, by=0.2), "Wv": draw(hidden, depth, by=0.2), "Wo": draw(depth, hidden, by=0.2),
                "R": np.zeros(CONTEXT + SCORED, np.float32), "b": np.zeros(hidden, np.float32), "O": draw(hidden, classes, by=0.15), "c": np.zeros(classes, np.float32), "T": usual[None] + draw(classes, m, by=0.5),
            }
        )

    @staticmethod
    def distances() -> tuple[np.ndarray, np.ndarray]:
        """(distance, future): from each scored position of a window to each position in it."""
        ago = np.arange(CONTEXT, CONTEXT + SCORED)[:, None] - np.arange(CONTEXT + SCORED)[None]
        return np.maximum(ago, 0), ago < 0

    def forward(self, x: np.ndarray, y: np.ndarray, by_id: np.ndarray | None = None) -> dict[str, np.ndarray]:
        """x: inputs (n, length), y: targets (n, scored).  p: the probability of each target; by_id (ids, classes) stands for T if given."""
        w, now, last = self.weights, x[:, CONTEXT:], x[:, CONTEXT - 1 : -1]
        ago, future = self.distances()
        q, k, v = (w["E"] @ w[n] for n in ("Wq", "Wk", "Wv"))
        q, k, v = q.take(now, axis=0), k.take(x, axis=0), v.take(x, axis=0)
        s = q @ k.transpose(0, 2, 1)
        s *= np.float32(w["Wq"].shape[1] ** -0.5)
        s += w["R"][ago]
        a = _softmax(s, ~future)
        o = a @ v
        h = np.maximum((w["E"] + w["b"]).take(now, axis=0) + w["P"].take(last, axis=0) + (o.reshape(-1, o.shape[-1]) @ w["Wo"]).reshape(*now.shape, -1), 0)
        pi = _softmax((h.reshape(-1, h.shape[-1]) @ w["O"] + w["c"]).reshape(*now.shape, -1))
        phi = _softmax(w["T"]) if by_id is None else by_id.T
        e = np.ascontiguousarray(phi.T).take(y, axis=0)
        return {"q": q, "k": k, "v": v, "a": a, "o": o, "h": h, "pi": pi, "phi": phi, "e": e, "p": (pi * e) @ np.ones(pi.shape[-1], e.dtype)}

    def _back(self, x: np.ndarray, f: dict[str, np.ndarray], r: np.ndarray, dz: np.ndarray) -> dict[str, np.ndarray]:
        """The gradient by all weights but T, from that by the classes' logits."""
        w, now, last = self.weights, x[:, CONTEXT:], x[:, CONTEXT - 1 : -1]
        ago, _ = self.distances()
        flat_h, flat_z = f["h"].reshape(-1, f["h"].shape[-1]), dz.reshape(-1, dz.shape[-1])
        g = {"O": flat_h.T @ flat_z, "c": flat_z.sum(axis=0)}
        dh = (flat_z @ w["O"].T * (flat_h > 0)).reshape(f["h"].shape)
        flat = dh.reshape(-1, dh.shape[-1])
        g["b"], g["Wo"] = flat.sum(axis=0), f["o"].reshape(-1, f["o"].shape[-1]).T @ flat
        do = (flat @ w["Wo"].T).reshape(f["o"].shape)
        da = do @ f["v"].transpose(0, 2, 1)
        da -= np.einsum("nsd,nsd->ns", do, f["o"])[..., None]
        da *= f["a"]
        g["R"] = np.bincount(ago.ravel(), weights=da.sum(axis=0).ravel(), minlength=len(w["R"])).astype(np.float32)
        scale, m = np.float32(w["Wq"].shape[1] ** -0.5), len(w["E"])
        dq = da @ f["k"] * scale
        dkv = np.concatenate((da.transpose(0, 2, 1) @ f["q"] * scale, f["a"].transpose(0, 2, 1) @ do), axis=-1)
        by_now, by_any, depth = sums_by(now, np.concatenate((dh, dq), axis=-1), m), sums_by(x, dkv, m), dq.shape[-1]
        g["P"], g["E"] = sums_by(last, dh, m), by_now[:, :-depth].copy()
        for name, table in (("Wq", by_now[:, -depth:]), ("Wk", by_any[:, :depth]), ("Wv", by_any[:, depth:])):
            g[name] = w["E"].T @ table
            g["E"] += table @ w[name].T
        return g

    def gradient(self, x: np.ndarray, y: np.ndarray, mask: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """(loss, its gradient): the mean of -ln p over the targets that mask (n, scored) names."""
        f = self.forward(x, y)
        m = (mask / max(1, mask.sum())).astype(np.float32)[..., None]
        r = f["pi"] * f["e"] / f["p"][..., None] * m
        g = self._back(x, f, r, f["pi"] * m - r)
        g["T"] = r.sum(axis=(0, 1))[:, None] * f["phi"] - sums_by(y, r, self.weights["T"].shape[1]).T
        return float(-(np.log(f["p"]) * m[..., 0]).sum()), g


def sums_by(index: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """(n, width): the sums of the values' rows for each index."""
    index, values = index.ravel(), values.reshape(-1, values.shape[-1])
    out = np.zeros((n, values.shape[-1]), values.dtype)
    if len(index):
        order = np.argsort(index.astype(np.uint16) if n <= 1 << 16 else index, kind="stable")
        have = index.take(order)
        starts = np.flatnonzero(np.concatenate(([True], have[1:] != have[:-1])))
        counts = np.diff(starts, append=len(have))
        # most indexes are rare: the k-th rows of all of them are added at once, the most frequent indexes first; what is left is of few indexes
        less = np.maximum(-counts, -FEW - 1).astype(np.int16)
        by = np.argsort(less, kind="stable")
        starts, counts, less = starts.take(by), counts.take(by), less.take(by)
        sums = values.take(order.take(starts), axis=0)
        held = np.searchsorted(less, -np.arange(1, FEW + 1)).tolist()  # how many indexes have more than k rows
        for k, m in enumerate(held[:-1], 1):
            if not m:
                break
            sums[:m] += values.take(order.take(starts[:m] + k), axis=0)
        ones = np.ones(int(counts.max()), values.dtype)
        for i in range(held[-1]):
            more = order[starts[i] + FEW : starts[i] + counts[i]]
            sums[i] += ones[: len(more)] @ values.take(more, axis=0)
        out[have.take(starts)] = sums
    return out


def _norm(table: np.ndarray) -> float:
    """The longest row's length."""
    return float(np.sqrt((np.square(table) @ np.ones(table.shape[1], table.dtype)).max()))


class Learner:
    """Goes over windows once, and can be put together with others that went over other windows.

    What is learned is a row for each id and a row of all that is not of one id.  An id's row has its E and P, its share in
    each class, and the squares of E's and P's gradients so far.  Classes learn by stepwise expectation maximization: shares move toward the
    responsibilities of the classes for the ids that were met, a step's part falling as 2 / (steps + 2).  All other
    weights descend the gradient, each at a rate that falls with its own squares.
    """

    SMALL = ("Wq", "Wk", "Wv", "Wo", "R", "b", "O", "c")

    def __init__(self, ids: int, seed: int = 1) -> None:
        w = Attention.new(np.ones(ids), seed=seed).weights
        self.model, self.hidden = Attention(w), w["E"].shape[1]
        share = _softmax(w.pop("T")).T / w["c"].size
        self.rows = np.concatenate((w.pop("E"), w.pop("P"), share, np.zeros((ids, 2), np.float32)), axis=1).astype(np.float32)
        self.squares = {name: np.zeros_like(w[name]) for name in self.SMALL}
        self.steps, self.seen = 0.0, 0
        self.table = np.zeros(ids, np.int32)

    def small(self) -> np.ndarray:
        """All that is not of one id, in one row."""
        w = self.model.weights
        return np.concatenate([*(w[n].ravel() for n in self.SMALL), *(self.squares[n].ravel() for n in self.SMALL), [self.steps]]).astype(np.float64)

    def begin(self, rows: np.ndarray, small: np.ndarray) -> Learner:
        """Go on from these rows."""
        w, at = self.model.weights, 0
        for kept in (w, self.squares):
            for n in self.SMALL:
                kept[n] = small[at : at + w[n].size].reshape(w[n].shape).astype(np.float32)
                at += w[n].size
        self.rows, self.steps, self.seen, self.fade = rows.astype(np.float32), float(small[at]), 0, 1.0
        self.total = self.rows[:, 2 * self.hidden : -2].sum(axis=0)
        return self

    def learn(self, ids: np.ndarray, lengths: np.ndarray, before: np.ndarray | None = None) -> None:
        """One step for each BATCH windows of documents laid end to end."""
        inputs, place = stream(ids, lengths, before)
        length = STRETCH * SCORED
        n = -(-(len(inputs) - CONTEXT) // length)
        x, scored = np.full(CONTEXT + n * length + 1, START, dtype=np.int32), np.zeros(CONTEXT + n * length + 1, dtype=bool)
        x[: len(inputs)], scored[place] = inputs, True
        x, scored = (np.lib.stride_tricks.sliding_window_view(v, CONTEXT + length + 1)[::length] for v in (x, scored))
        order = np.random.default_rng(n).permutation(n)
        for at in range(0, n, BATCH // STRETCH):
            some = order[at : at + BATCH // STRETCH]
            self._step(x[some], scored[some, CONTEXT + 1 :])
        self.seen += len(ids)

    def gradient(self, x: np.ndarray, part: np.ndarray, phi: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """(gradient of the mean of -ln p by all weights but T, responsibilities of the classes by id).

        x: stretches of the stream with the ids behind them (n, CONTEXT + STRETCH * SCORED + 1), part: which of those from CONTEXT + 1 on are scored, phi: classes of each id (ids, classes).
        """
        g, sums = self._gradient(x, part, phi)
        return g | {"E": sums[:, : self.hidden], "P": sums[:, self.hidden : 2 * self.hidden]}, sums[:, 2 * self.hidden :]

    def _gradient(self, x: np.ndarray, part: np.ndarray, phi: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """(gradient by the weights in SMALL, that by E and P and the responsibilities side by side)."""
        w, n, long, ago, future = self.model.weights, len(x), x.shape[1] - CONTEXT - 1, *self.model.distances()
        depth, hidden, m, f4 = w["Wq"].shape[1], w["E"].shape[1], len(w["E"]), np.float32
        scale, one, scored = f4(depth**-0.5), np.ones(depth, f4), f4(part.sum())
        by_all = np.concatenate((w["Wq"] * scale, w["Wk"], w["Wv"]), axis=1)
        qkv = w["E"] @ by_all
        looked = np.concatenate((w["E"] + w["b"], qkv, np.ones((m, 1), f4)), axis=1).take(x[:, :-1], axis=0)
        kv = _paired(looked[..., hidden + depth :].reshape(n, -1, SCORED, 2 * depth + 1))
        across, ks, v1 = np.ascontiguousarray(kv.transpose(0, 2, 1)), kv[..., :depth], kv[..., depth:]
        qs = looked[:, CONTEXT:, hidden : hidden + depth].reshape(-1, SCORED, depth)
        a = qs @ across[:, :depth]
        a += np.where(future, f4(-1e9), w["R"][ago]).astype(f4)
        if _norm(qkv[:, :depth]) * _norm(qkv[:, depth : 2 * depth]) + float(np.abs(w["R"]).max()) > SAFE:
            a -= a.max(axis=-1, keepdims=True)
        np.exp(a, out=a)  # its rows are divided by their sums where they are narrow
        o = a @ v1
        total = o[..., depth:]
        o = o[..., :depth] / total
        h = o.reshape(-1, depth) @ w["Wo"]
        h.reshape(n, long, hidden)[...] += looked[:, CONTEXT:, :hidden]
        h += w["P"].take(x[:, CONTEXT - 1 : -2].ravel(), axis=0)
        np.maximum(h, 0, out=h)
        z = h @ w["O"]
        z += w["c"]
        if max(z.max(), -z.min()) > SAFE:
            z -= z.max(axis=-1, keepdims=True)
        np.exp(z, out=z)
        r = phi.take(x[:, CONTEXT + 1 :].ravel(), axis=0)
        r *= z
        on, ones = part.ravel().astype(f4), np.ones(len(h), f4)
        r *= (on / (r @ ones[: r.shape[1]]))[:, None]
        z *= (on / (z @ ones[: z.shape[1]]))[:, None]
        z -= r  # now the gradient by the classes' logits, but for the number of ids that are scored
        g = {"O": h.T @ z / scored, "c": ones @ z / scored}
        dh = z @ (w["O"].T / scored)
        dh *= h > 0
        g["b"], g["Wo"] = ones @ dh, o.reshape(-1, depth).T @ dh
        do = np.empty((*o.shape[:2], depth + 1), f4)
        np.divide((dh @ w["Wo"].T).reshape(o.shape), total, out=do[..., :depth])
        do[..., depth] = -((do[..., :depth] * o) @ one)
        ds = do @ across[:, depth:]
        ds *= a
        g["R"] = np.bincount(ago.ravel(), weights=ones[: len(ds)] @ ds.reshape(len(ds), -1), minlength=len(w["R"])).astype(f4)
        back = np.empty((len(ds), 2 * SCORED, 2 * depth), f4)
        np.matmul(ds.transpose(0, 2, 1), qs, out=back[..., :depth])
        np.matmul(a.transpose(0, 2, 1), do[..., :depth], out=back[..., depth:])
        back = back.reshape(n, -1, 2, SCORED, 2 * depth)
        # a row for each place: what goes to E and P of its id, its responsibilities, and what goes to q, k and v
        at = np.cumsum([0, hidden, hidden, r.shape[1], depth, 2 * depth])
        every = np.empty((n, x.shape[1], at[-1]), f4)
        every[:, : CONTEXT + 1] = every[:, -CONTEXT - 1 :, at[4] :] = every[:, -2:] = 0
        every[:, CONTEXT:-1, : at[1]] = every[:, CONTEXT - 1 : -2, at[1] : at[2]] = dh.reshape(n, long, -1)
        every[:, CONTEXT + 1 :, at[2] : at[3]] = r.reshape(n, long, -1)
        every[:, CONTEXT:-1, at[3] : at[4]] = (ds @ ks).reshape(n, long, -1)
        every[:, : -CONTEXT - 1, at[4] :] = back[:, :, 0].reshape(n, long, -1)
        every[:, CONTEXT:-1, at[4] :] += back[:, :, 1].reshape(n, long, -1)
        sums = sums_by(x, every, m)
        by_qkv = sums[:, at[3] :]
        g["Wq"], g["Wk"], g["Wv"] = np.split(w["E"].T @ by_qkv, 3, axis=1)
        g["Wq"] = g["Wq"] * scale
        sums[:, : at[1]] += by_qkv @ by_all.T
        return g, sums[:, : at[3]]

    def _step(self, x: np.ndarray, part: np.ndarray) -> None:
        n = part.sum()
        if not n:
            return
        h, w, met = self.hidden, self.model.weights, np.zeros(len(self.rows), dtype=bool)
        met[x] = True
        own = np.flatnonzero(met)  # the step works on the rows of the ids that it meets
        self.table[own] = np.arange(len(own))
        x, rows = self.table.take(x), self.rows.take(own, axis=0)
        w["E"], w["P"] = rows[:, :h].copy(), rows[:, h : 2 * h].copy()
        part_of = self.total + LEAST
        phi = rows[:, 2 * h : -2] * (np.float32(self.fade) / part_of).astype(np.float32) + (LEAST / len(self.rows) / part_of).astype(np.float32)
        g, sums = self._gradient(x, part, phi)
        self.steps += 1
        for name in self.SMALL:
            self.squares[name] += g[name] ** 2
            w[name] = w[name] - np.float32(RATE) * g[name] / (np.sqrt(self.squares[name]) + np.float32(1e-6))
        both, moved = sums[:, : 2 * h], sums[:, 2 * h :]
        rows[:, -2:] += (np.square(both).reshape(-1, h) @ np.full(h, 1 / h, np.float32)).reshape(-1, 2)
        rate = np.float32(-RATE) / (np.sqrt(rows[:, -2:]) + np.float32(1e-6))
        rows[:, : 2 * h] += (both.reshape(-1, 2, h) * rate[..., None]).reshape(-1, 2 * h)
        new = 2 / (self.steps + 2)
        self.fade *= 1 - new
        rows[:, 2 * h : -2] += moved * np.float32(new / self.fade / n)
        self.total = self.total * (1 - new) + np.ones(len(moved), np.float32) @ moved * np.float32(new / n)
        self.rows[own] = rows
        if self.fade < 1e-3:
            self._settle()

    def _settle(self) -> None:
        self.rows[:, 2 * self.hidden : -2] *= np.float32(self.fade)
        self.fade = 1.0

    def learned(self) -> np.ndarray:
        """The rows of ids as they are now."""
        self._settle()
        return self.rows

    def finished(self) -> Attention:
        """The model."""
        h, rows = self.hidden, self.learned()
        share = rows[:, 2 * h : -2]
        share = share + np.maximum(share.sum(axis=0), 1e-30) * np.float32(FLOOR / len(rows))
        w = self.model.weights
        return Attention({"E": rows[:, :h].copy(), "P": rows[:, h : 2 * h].copy(), **{n: w[n] for n in self.SMALL}, "T": np.log(share).T.astype(np.float32).copy()})


class Scorer:
    """Fast forward passes: what depends on one id alone is looked up."""

    def __init__(self, model: Attention) -> None:
        w = model.weights
        self.depth, self.hidden = w["Wo"].shape
        q = (w["E"] @ w["Wq"]) * np.float32(self.depth**-0.5)
        self.kv = np.concatenate((w["E"] @ w["Wk"], w["E"] @ w["Wv"], np.ones((len(q), 1))), axis=1).astype(np.float32)
        self.now, self.last = np.concatenate((w["E"] + w["b"], q), axis=1).astype(np.float32), w["P"].astype(np.float32)
        self.wo, self.o, self.c = (w[n].astype(np.float32) for n in ("Wo", "O", "c"))
        self.emission = np.ascontiguousarray(_softmax(w["T"]).T, dtype=np.float32)
        ago, future = model.distances()
        self.bias = np.where(future, np.float32(-1e9), w["R"][ago]).astype(np.float32)
        self.all = np.ones(len(self.c), np.float32)
        #: Whether no score can be so large that exp() overflows.
        self.tame = _norm(q) * _norm(self.kv[:, : self.depth]) + float(np.abs(w["R"]).max()) < SAFE

    def log10(self, ids: np.ndarray, lengths: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
        """log10 p of each id of documents laid end to end, given those before it."""
        inputs, place = stream(ids, lengths, before)
        inputs = np.append(inputs, np.int32(START))
        out, step = np.empty(len(inputs), np.float32), TOGETHER * SCORED
        for at in range(0, len(inputs) - CONTEXT - 1, step):
            out[at + CONTEXT + 1 : at + CONTEXT + 1 + step] = self._some(inputs[at : at + CONTEXT + 1 + step])
        return np.log10(np.maximum(out[place], np.float32(1e-37)), dtype=np.float64)

    def _some(self, x: np.ndarray) -> np.ndarray:
        """p of each id of a stretch behind its first CONTEXT + 1."""
        kv = _paired(self.kv.take(x[:-1], axis=0).reshape(1, -1, SCORED, self.kv.shape[1]))
        now = self.now.take(x[CONTEXT:-1], axis=0)
        s = now[:, self.hidden :].reshape(-1, SCORED, self.depth) @ np.ascontiguousarray(kv[..., : self.depth].transpose(0, 2, 1))
        s += self.bias
        if not self.tame:
            s -= s.max(axis=-1, keepdims=True)
        np.exp(s, out=s)
        o = s @ kv[..., self.depth :]
        h = (o[..., : self.depth] / o[..., self.depth :]).reshape(len(now), -1) @ self.wo
        h += now[:, : self.hidden]
        h += self.last.take(x[CONTEXT - 1 : -2], axis=0)
        np.maximum(h, 0, out=h)
        z = h @ self.o
        z += self.c
        if z.max() > SAFE or z.min() < -SAFE:
            z -= z.max(axis=-1, keepdims=True)
        np.exp(z, out=z)
        total = z @ self.all
        z *= self.emission.take(x[CONTEXT + 1 :], axis=0)
        return z @ self.all / total
