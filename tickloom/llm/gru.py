"""A small gated recurrent language model in numpy, with a class-factored softmax.

Words are numbered by frequency: 0 is the end of a text, 1.. the next most frequent, the last number is
every other word. Modelled words sit in classes of equal size by frequency, the other words are a class
of their own: P(word | h) = P(class | h) P(word | class, h). Output biases begin at the counts, so the
untrained model is the unigram model.

Texts run in lanes, one after the other; a lane's state is carried from window to window and reset at
the start of a text, so a text's log-likelihood is that of the whole text however long it is. Only
training cuts long texts into segments, so that its lanes stay filled.
"""

from __future__ import annotations

import heapq

import numpy as np

HIDDEN = 16
CLASS = 64
#: Steps of truncated backpropagation, and of scoring, at a time.
WINDOW = 32
SCORED = 64
#: Training reads long texts as segments side by side; each first reads the words before it to get a state.
SEGMENT = 1024
LEAD = 64
#: Lanes of training and of scoring.
LANES = 256
WIDE = 512


def initial(counts: np.ndarray, seed: int = 0) -> dict[str, np.ndarray]:
    """Parameters for words with these counts: modelled words (a multiple of CLASS), then all others in one."""
    words, groups, h = len(counts) - 1, (len(counts) - 1) // CLASS, HIDDEN
    rng = np.random.default_rng(seed)
    share = (counts + 0.5) / (counts.sum() + 0.5 * len(counts))
    of_group = np.append(share[:words].reshape(groups, CLASS).sum(1), share[words])
    return {
        "embed": rng.standard_normal((words + 1, h)).astype(np.float32) * 0.3,
        "gates": rng.standard_normal((2 * h, 2 * h)).astype(np.float32) * (2 * h) ** -0.5,
        "gates_bias": np.zeros(2 * h, np.float32),
        "cand": rng.standard_normal((2 * h, h)).astype(np.float32) * (2 * h) ** -0.5,
        "cand_bias": np.zeros(h, np.float32),
        "group": np.zeros((h, groups + 1), np.float32),
        "group_bias": np.log(of_group).astype(np.float32),
        "word": np.zeros((groups, h, CLASS), np.float32),
        "word_bias": np.log(share[:words].reshape(groups, CLASS) / of_group[:groups, None]).astype(np.float32),
    }


def packed(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in sorted(p)])


def shapes(p: dict[str, np.ndarray]) -> dict[str, tuple[int, ...]]:
    return {k: v.shape for k, v in p.items()}


def unpacked(flat: np.ndarray, shape: dict[str, tuple[int, ...]]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k in sorted(shape):
        size = int(np.prod(shape[k]))
        out[k] = flat[at : at + size].reshape(shape[k]).astype(np.float32)
        at += size
    return out


def lanes(lengths: list[int], most: int = LANES) -> list[list[int]]:
    """Texts dealt to lanes of about equal length, longest first; no more lanes than their lengths warrant."""
    total, longest = sum(lengths), max(lengths)
    n = max(1, min(most, len(lengths), -(-total // longest) * 2))
    heap = [(0, i) for i in range(n)]
    out: list[list[int]] = [[] for _ in range(n)]
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        size, lane = heapq.heappop(heap)
        out[lane].append(i)
        heapq.heappush(heap, (size + lengths[i], lane))
    return out


def laid_out(texts: list[np.ndarray], most: int = LANES, skips: list[int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(steps, lanes) arrays: the word before, the word, the text's number (-1: nothing, or one of the first ``skips`` words), and 0 where a text begins (else 1)."""
    plan = lanes([len(x) for x in texts], most)
    steps = max(sum(len(texts[i]) for i in lane) for lane in plan)
    words = np.zeros((steps, len(plan)), np.int32)
    starts = np.ones((steps, len(plan)), np.float32)
    owner = np.full((steps, len(plan)), -1, np.int32)
    for k, lane in enumerate(plan):
        at = 0
        for i in lane:
            words[at : at + len(texts[i]), k] = texts[i]
            owner[at + (skips[i] if skips else 0) : at + len(texts[i]), k] = i
            starts[at, k] = 0
            at += len(texts[i])
    previous = np.vstack((np.zeros((1, len(plan)), np.int32), words[:-1]))
    previous[starts == 0] = 0  # a text begins after an end
    return previous, words, owner, starts


def forward(p: dict, previous: np.ndarray, starts: np.ndarray, h: np.ndarray, keep: bool = False) -> tuple[np.ndarray, tuple]:
    """States after each step of a window; with keep, what the backward pass needs."""
    n = len(p["cand_bias"])
    # sigmoid(x) = (1 + tanh(x / 2)) / 2: the gates' weights are halved once
    half = p["gates"] * np.float32(0.5)
    x_gates = p["embed"] @ half[:n] + p["gates_bias"] * np.float32(0.5)
    x_cand = p["embed"] @ p["cand"][:n] + p["cand_bias"]
    w_gates, w_cand = half[n:], p["cand"][n:]
    kind, shape = p["embed"].dtype, previous.shape
    states = np.empty((*shape, n), kind)
    # what each step had: the state before it, both gates, the gated state and the candidate
    saved = tuple(np.empty((*shape, m), kind) for m in (n, 2 * n, n, n)) if keep else ()
    in_gates, in_cand, begins = x_gates[previous], x_cand[previous], (starts == 0).any(1)
    for t in range(len(previous)):
        if begins[t]:
            h = h * starts[t][:, None]
        g = in_gates[t]
        g += h @ w_gates
        np.tanh(g, out=g)
        g *= 0.5
        g += 0.5
        rh = g[:, n:] * h
        c = in_cand[t]
        c += rh @ w_cand
        np.tanh(c, out=c)
        if keep:
            saved[0][t], saved[1][t], saved[2][t], saved[3][t] = h, g, rh, c
        step = np.subtract(c, h, out=states[t])
        step *= g[:, :n]
        step += h
        h = step
    return states, saved


def _normalised(logits: np.ndarray, picked: np.ndarray, grad: bool) -> tuple[np.ndarray, np.ndarray | None]:
    """Log-probability of the picked row of each column; with grad the gradient of its negative by the logits."""
    logits -= logits.max(0)
    columns = np.arange(logits.shape[1])
    chosen = logits[picked, columns].astype(np.float64)
    np.exp(logits, out=logits)
    total = logits.sum(0)
    chosen -= np.log(total)
    if grad:
        logits /= total
        logits[picked, columns] -= 1
    return chosen, logits if grad else None


def outputs(p: dict, states: np.ndarray, words: np.ndarray, grad: bool = False):
    """Log-probability (natural) of each word given its state; with grad also the gradients of its negative sum."""
    groups, n, size = p["word"].shape
    group = (words // size).astype(np.int16)  # the other words have a class of their own
    order = np.argsort(group, kind="stable")
    s, group, word = np.ascontiguousarray(states[order].T), group[order], words[order]
    logs, d = _normalised(p["group"].T @ s + p["group_bias"][:, None], group, grad)
    if grad:
        g = {"group": s @ d.T, "group_bias": d.sum(1), "word": np.zeros_like(p["word"]), "word_bias": np.zeros_like(p["word_bias"])}
        d_s = p["group"] @ d
    bounds = np.searchsorted(group, np.arange(groups + 1))
    for k in np.flatnonzero(np.diff(bounds)).tolist():
        part = slice(bounds[k], bounds[k + 1])
        inner, d = _normalised(p["word"][k].T @ s[:, part] + p["word_bias"][k][:, None], word[part] - k * size, grad)
        logs[part] += inner
        if grad:
            g["word"][k], g["word_bias"][k] = s[:, part] @ d.T, d.sum(1)
            d_s[:, part] += p["word"][k] @ d
    out = np.empty_like(logs)
    out[order] = logs
    if not grad:
        return out
    d_states = np.empty_like(states)
    d_states[order] = d_s.T
    return out, g, d_states


def log_likelihood(p: dict, texts: list[np.ndarray], window: int = SCORED) -> np.ndarray:
    """Natural log-probability of each whole text (each ends with 0)."""
    total = np.zeros(len(texts))
    if not texts:
        return total
    previous, words, owner, starts = laid_out(texts, WIDE)
    h = np.zeros((words.shape[1], len(p["cand_bias"])), np.float32)
    for t in range(0, len(words), window):
        part = slice(t, t + window)
        states, _ = forward(p, previous[part], starts[part], h)
        h = states[-1]
        real = owner[part] >= 0
        found = outputs(p, states[real], words[part][real])
        total += np.bincount(owner[part][real], found, len(texts))
    return total


class Trainer:
    """Adam on windows of truncated backpropagation."""

    def __init__(self, p: dict, rate: float = 0.02):
        self.p, self.rate, self.n = {k: v.copy() for k, v in p.items()}, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in p.items()}
        self.v = {k: np.zeros_like(v) for k, v in p.items()}
        self.tokens = 0

    def learn(self, texts: list[np.ndarray]) -> None:
        """One pass over all words of the texts. Segments of a long text are read side by side, each after a lead that only sets the state."""
        if not texts:
            return
        begins = [(x, k) for x in texts for k in range(0, len(x), SEGMENT)]
        texts, skips = [x[max(0, k - LEAD) : k + SEGMENT] for x, k in begins], [min(k, LEAD) for _, k in begins]
        # few words get few lanes, so that there are some steps of the optimiser
        previous, words, owner, starts = laid_out(texts, max(8, min(LANES, sum(map(len, texts)) // (32 * WINDOW))), skips)
        h = np.zeros((words.shape[1], len(self.p["cand_bias"])), np.float32)
        for t in range(0, len(words), WINDOW):
            part = slice(t, t + WINDOW)
            h = self._window(previous[part], words[part], owner[part] >= 0, starts[part], h)

    def _window(self, previous, words, real, starts, h):
        p, n = self.p, len(self.p["cand_bias"])
        states, saved = forward(p, previous, starts, h, keep=True)
        count = int(real.sum())
        if not count:
            return states[-1]
        _, g, d_out = outputs(p, states[real], words[real], grad=True)
        d_states = np.zeros_like(states)
        d_states[real] = d_out
        begins = (starts == 0).any(1)
        before, gates, gated, cand = saved
        z, r = gates[..., :n], gates[..., n:]
        to_cand, to_z, to_r, stay = z * (1 - cand * cand), (cand - before) * z * (1 - z), before * r * (1 - r), 1 - z
        d_gates, d_cand = np.empty_like(gates), np.empty_like(cand)
        w_gates, w_cand = p["gates"][n:].T, p["cand"][n:].T
        dh = np.zeros_like(h)
        for t in range(len(words) - 1, -1, -1):
            dh += d_states[t]
            dc = np.multiply(dh, to_cand[t], out=d_cand[t])
            drh, dg = dc @ w_cand, d_gates[t]
            np.multiply(dh, to_z[t], out=dg[:, :n])
            np.multiply(drh, to_r[t], out=dg[:, n:])
            dh *= stay[t]
            drh *= r[t]
            dh += drh
            dh += dg @ w_gates
            if begins[t]:
                dh *= starts[t][:, None]
        flat, dg, dc = previous.ravel(), d_gates.reshape(-1, 2 * n), d_cand.reshape(-1, n)
        x = p["embed"][flat]
        g["gates"] = np.concatenate((x.T @ dg, before.reshape(-1, n).T @ dg))
        g["cand"] = np.concatenate((x.T @ dc, gated.reshape(-1, n).T @ dc))
        g["gates_bias"], g["cand_bias"] = dg.sum(0), dc.sum(0)
        d_x = dg @ p["gates"][:n].T + dc @ p["cand"][:n].T
        order = np.argsort(flat, kind="stable")
        first = np.flatnonzero(np.diff(flat[order], prepend=-1))
        g["embed"] = np.zeros_like(p["embed"])
        g["embed"][flat[order][first]] = np.add.reduceat(d_x[order], first)
        norm = np.sqrt(sum(float(v.ravel() @ v.ravel()) for v in g.values())) / count
        scale = np.float32(min(1.0, 1.0 / max(norm, 1e-9)) / count)
        self.n += 1
        self.tokens += count
        step = self.rate * min(1.0, self.n / 20) * np.sqrt(1 - 0.999**self.n) / (1 - 0.9**self.n)
        for k, v in g.items():
            m, s, v = self.m[k], self.v[k], v * scale
            m *= 0.9
            m += np.float32(0.1) * v
            v *= v
            v *= 0.001
            s *= 0.999
            s += v
            np.sqrt(s, out=v)
            v += 1e-8
            np.divide(m, v, out=v)
            v *= step
            p[k] -= v
        return states[-1]
