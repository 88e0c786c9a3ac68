"""A gated recurrent language model in numpy: class-factored softmax, truncated backpropagation, state over windows."""

from heapq import heapify, heappop, heappush

import numpy as np

#: Words that the network knows, classes they are dealt to, and units.
WORDS, CLASSES, UNITS = 16384, 128, 16
#: Classes and input rows that all other words are hashed to.
OTHERS = 64
#: Tokens through which errors are propagated, and documents side by side in training and in scoring.
WINDOW, LANES, SCORE_LANES = 16, 256, 512
RATE, CLIP = 0.02, 5.0
#: Tokens of a document that are trained on in a row, and the longest window in scoring.
SEGMENT, LONGEST = 512, 1024
#: Rows of outputs that are made at a time, so that they stay in a core's cache.
ROWS = 1024
#: Numbers of a table that are trained at a time, and values of a row from which on they are summed by themselves.
PIECE, MANY = 1 << 13, 8
#: Neighbouring classes that share a call if none has more rows than this.
JOINED, FEW = 8, 48
#: Logits between the negative and this need no shift before they are raised to powers.
SAFE = 60


class Gru:
    """``P(word | state) = P(top | state) * P(class | top, state) * P(word | class, state)`` for known words.

    Known words are dealt into classes by frequency; the classes from ``classes`` on stand for other words, whose
    shares within them are not the network's business.  As many classes follow each other in a top class as there
    are top classes, so a token costs about twice the root of the number of classes, and one class of words.  Word ``0`` ends a document, and the words from ``words`` on
    are the classes of others.
    """

    def __init__(self, logs: np.ndarray, other: float | np.ndarray, units=UNITS, classes=CLASSES, seed=0):
        """``logs``: natural log probabilities of the known words, most frequent first; ``other``: of each class of others."""
        other = np.atleast_1d(other)
        rng = np.random.default_rng(seed)
        self.words, self.classes, self.units = len(logs), classes, units
        self.width = -(-self.words // classes)
        self.kind = np.minimum(np.arange(self.words) // self.width, classes - 1)
        self.slot = np.arange(self.words) - self.kind * self.width
        mass = np.full(classes + len(other), -np.inf)
        inner = np.full((classes, self.width), -30.0)
        inner[self.kind, self.slot] = logs
        mass[:classes] = np.logaddexp.reduce(inner, axis=1)
        mass[classes:] = other
        self.span = int(np.ceil(np.sqrt(len(mass))))
        self.tops = -(-len(mass) // self.span)
        middle = np.full(self.tops * self.span, -30.0)
        middle[: len(mass)] = np.maximum(mass, -30)
        middle = middle.reshape(self.tops, self.span)
        h = units
        draw = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(np.float32)

        def biased(logs):
            """Tables of outputs, one for each row of ``logs``: no weights, and the bias as the last row."""
            return np.concatenate([np.zeros((len(logs), h, logs.shape[1])), logs[:, None]], 1).astype(np.float32)

        # Begins as the unigram model: weights of the outputs are zero and their biases are log frequencies.
        self.p = {
            "input": draw(self.words + len(other), 3 * h),
            "gates": draw(h, 2 * h),
            "new": draw(h, h),
            "bias": np.zeros(3 * h, np.float32),
            "top": biased(np.logaddexp.reduce(middle, axis=1)[None]),
            "class": biased(middle),
            "word": biased(inner),
        }

    def vector(self) -> np.ndarray:
        return np.concatenate([v.ravel() for v in self.p.values()])

    def load(self, vector: np.ndarray):
        at = 0
        for name, v in self.p.items():
            self.p[name] = vector[at : at + v.size].reshape(v.shape).astype(np.float32)
            at += v.size

    def inputs(self) -> np.ndarray:
        """What each token brings to the gates, negated as the sigmoid takes it, and to the new state."""
        p, h = self.p, self.units
        return (p["input"] + p["bias"]) * np.repeat(np.array([-1, 1], p["input"].dtype), (2 * h, h))

    def forward(self, tokens: np.ndarray, state: np.ndarray, keep=False, fresh=None, given=None):
        """States before each token of ``tokens`` (time, lane) and the state after the last; an end resets a lane.

        ``fresh`` marks the tokens that begin without a state, whatever came before them in the lane.  Inside, units
        come before lanes, so that a step's numbers lie in one piece.  With ``keep``, what `gradients` needs follows.
        ``given`` are the `inputs`, for many windows of one model.
        """
        p, h = self.p, self.units
        steps, lanes = tokens.shape
        kind = np.result_type(p["gates"], state)
        if given is not None:
            inputs = np.ascontiguousarray(given.take(tokens, axis=0).transpose(0, 2, 1), kind)
        else:
            rows = p["input"].take(tokens, axis=0)
            rows += p["bias"]
            inputs = np.empty((steps, 3 * h, lanes), kind)
            np.negative(rows[:, :, : 2 * h].transpose(0, 2, 1), out=inputs[:, : 2 * h])
            inputs[:, 2 * h :] = rows[:, :, 2 * h :].transpose(0, 2, 1)
        to_gates, to_new = -p["gates"].T, np.ascontiguousarray(p["new"].T)
        live, ends = (tokens != 0).astype(kind), (tokens == 0).any(1).tolist()
        kept, begins = (None, [False] * steps) if fresh is None else ((~fresh).astype(kind), fresh.any(1).tolist())
        before = np.empty((steps, h, lanes), kind)
        gates, new = np.empty((steps if keep else 1, 2 * h, lanes), kind), np.empty((steps if keep else 1, h, lanes), kind)
        held, now = np.empty((h, lanes), kind), state.T.astype(kind)
        for t in range(steps):
            at = t if keep else 0
            if begins[t]:
                now = now * kept[t]
            before[t] = now
            gate, value = gates[at], new[at]
            np.matmul(to_gates, now, out=gate)
            gate += inputs[t, : 2 * h]
            np.exp(gate, out=gate)
            gate += 1
            np.reciprocal(gate, out=gate)
            np.multiply(gate[h:], now, out=held)
            np.matmul(to_new, held, out=value)
            value += inputs[t, 2 * h :]
            np.tanh(value, out=value)
            now = value - now
            now *= gate[:h]
            now += before[t]
            if ends[t]:
                now *= live[t]
        saved = (before, gates, new, live, ends, kept, begins) if keep else None
        return np.ascontiguousarray(before.transpose(0, 2, 1), np.float32), now.T, saved

    def log_probability(self, states: np.ndarray, tokens: np.ndarray, weights=None):
        """Log probability of each token at its state (for another word: of its class of others).

        With ``weights`` (0 or 1 for each token), also the gradients of the sum, by parameter, and at the states.
        """
        p, h = self.p, self.units
        other = tokens >= self.words
        kind = np.where(other, self.classes + tokens - self.words, self.kind[np.minimum(tokens, self.words - 1)])
        # Tokens in order of their classes: a class is a slice, and a few classes at a time make a block.
        order = np.argsort(_short(kind, self.classes + len(p["input"])), kind="stable")
        sizes = np.bincount(kind, minlength=self.classes)
        # Rows that only fill up a class come twice and weigh nothing.
        rooms, joined = _rooms(sizes, self.classes)
        kind = np.repeat(np.arange(len(rooms)), rooms)
        place = np.arange(len(kind)) - (np.cumsum(rooms) - rooms)[kind]
        real = place < sizes[kind]
        order = order[np.minimum((np.cumsum(sizes) - sizes)[kind] + place, len(order) - 1)]
        # Where each token's row is.
        back_at = np.empty(len(tokens), np.int64)
        back_at[order[real]] = np.flatnonzero(real)
        near = np.ones((len(order), h + 1), np.result_type(states, p["word"]))
        near[:, :h] = states.take(order, axis=0)
        weighed = None if weights is None else weights[order] * real
        reach = float(np.abs(states).max(initial=0))
        out, back = np.zeros(len(order)), None if weights is None else np.zeros((len(order), h), near.dtype)
        grads = {} if weights is None else {k: np.zeros_like(p[k]) for k in ("top", "class", "word")}
        # Blocks are made in the same place, one after the other.
        made = {k: np.empty((min(ROWS, len(order)), p[k].shape[-1]), near.dtype) for k in ("top", "class", "word")}
        moved = None if weights is None else np.empty((min(ROWS, len(order)), h), near.dtype)

        def add(name, edges, at, joined=()):
            """What the softmaxes of ``name`` say: rows from ``edges[c]`` to ``edges[c + 1]`` are by table ``c``.

            Tables that are ``joined`` have as many rows as each other, and go through one call.
            """
            table, grad, ones = p[name], grads.get(name), np.ones(p[name].shape[-1], near.dtype)
            bias = np.abs(table[:, h].max(1)).max()
            most = h * max(float(table.max()), -float(table[:, :h].min()))
            shift = reach * most + bias > SAFE and reach * float(np.abs(table[:, :h]).sum(1).max()) + bias > SAFE
            for parts in _blocks(edges, joined):
                lo, hi = parts[0][2], parts[-1][3]
                each, block = np.arange(hi - lo), slice(lo, hi)
                found = made[name][: hi - lo]
                for c, d, x, y in parts:
                    if d - c == 1:
                        np.matmul(near[x:y], table[c], out=found[x - lo : y - lo])
                    else:
                        np.matmul(_split(near[x:y], d - c), table[c:d], out=_split(found[x - lo : y - lo], d - c))
                if shift:
                    found -= found.max(1, keepdims=True)
                chosen = found[each, at[block]]
                total = np.exp(found, out=found) @ ones
                out[block] += chosen - np.log(total)
                if weighed is None:
                    continue
                found *= (-weighed[block] / total)[:, None]
                found[each, at[block]] += weighed[block]
                for c, d, x, y in parts:
                    delta, to = found[x - lo : y - lo], moved[x - lo : y - lo]
                    if d - c > 1:
                        delta, own = _split(delta, d - c), table[c:d, :h].transpose(0, 2, 1)
                        np.matmul(_split(near[x:y], d - c).transpose(0, 2, 1), delta, out=grad[c:d])
                        np.matmul(delta, own, out=_split(to, d - c))
                        continue
                    if x == edges[c]:
                        np.matmul(near[x:y].T, delta, out=grad[c])
                    else:
                        grad[c] += near[x:y].T @ delta
                    np.matmul(delta, table[c][:h].T, out=to)
                back[block] += moved[: hi - lo]

        top = kind // self.span
        add("top", np.array([0, len(order)]), top)
        add("class", np.searchsorted(top, np.arange(self.tops + 1)), kind - top * self.span)
        edges = np.searchsorted(kind, np.arange(self.classes + 1))
        add("word", edges, np.where(real, self.slot[np.minimum(tokens[order], self.words - 1)], 0)[: edges[-1]], joined)
        told = out[back_at]
        if weights is None:
            return told
        return told, grads, back.take(back_at, axis=0)

    def gradients(self, tokens: np.ndarray, live: np.ndarray, state: np.ndarray, sparse=False, fresh=None):
        """Log likelihood of a window, its gradients (truncated at the window's start), and the state after it.

        With ``sparse``, the gradient of the input has the rows of ``np.unique(tokens)`` only.
        """
        p, h = self.p, self.units
        states, after, saved = self.forward(tokens, state, True, fresh)
        flat = tokens.ravel()
        out, grads, at = self.log_probability(states.reshape(-1, h), flat, live.ravel().astype(np.float32))
        before, gates, new, alive, ends, kept, begins = saved
        at = np.ascontiguousarray(at.reshape(*tokens.shape, h).transpose(0, 2, 1))
        update, reset = gates[:, :h], gates[:, h:]
        # What a step's error is multiplied by on its way to the new state, the update, the reset and the state before.
        stays = 1 - update
        to_new = 1 - new * new
        to_new *= update
        to_update = new - before
        to_update *= update
        to_update *= stays
        to_reset = 1 - reset
        to_reset *= reset
        to_reset *= before
        errors = np.empty((len(tokens), 3 * h, tokens.shape[1]), before.dtype)
        back, more = np.zeros_like(before[0]), np.empty_like(before[0])
        for t in range(len(tokens) - 1, -1, -1):
            error = errors[t]
            if ends[t]:
                back *= alive[t]
            np.multiply(back, to_update[t], out=error[:h])
            np.multiply(back, to_new[t], out=error[2 * h :])
            held = p["new"] @ error[2 * h :]
            np.multiply(held, to_reset[t], out=error[h : 2 * h])
            back *= stays[t]
            held *= reset[t]
            back += held
            np.matmul(p["gates"], error[: 2 * h], out=more)
            back += more
            back += at[t]
            if begins[t]:
                back *= kept[t]
        grads["new"] = np.matmul(reset * before, errors[:, 2 * h :].transpose(0, 2, 1)).sum(0)
        grads["gates"] = np.matmul(before, errors[:, : 2 * h].transpose(0, 2, 1)).sum(0)
        flat_inputs = np.ascontiguousarray(errors.transpose(0, 2, 1)).reshape(-1, 3 * h)
        grads["bias"] = np.ones(len(flat), errors.dtype) @ flat_inputs
        found, sums = _summed(_short(flat, len(p["input"])), flat_inputs)
        if not sparse:
            grads["input"] = np.zeros_like(p["input"])
            grads["input"][found] = sums
        else:
            grads["input"] = sums
        return float(out[live.ravel()].sum()), grads, after

    def train(self, documents: list[np.ndarray], window=WINDOW, lanes=LANES, rate=RATE):
        """One pass of Adam over documents (token ids, each ending in 0), side by side in lanes.

        Longer documents are cut into segments that begin without a state, so that lanes end together.  Only the
        input rows of a window's words change with it, so a window's cost does not grow with the vocabulary.
        """
        documents = [d[at : at + SEGMENT] for d in documents for at in range(0, len(d), SEGMENT)]
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        state, done = None, 0
        for tokens, live, fresh in windows(documents, window, lanes, starts=True):
            state = np.zeros((tokens.shape[1], self.units), np.float32) if state is None else state[: tokens.shape[1]]
            count = max(1, int(live.sum()))
            _, grads, state = self.gradients(tokens, live, state, sparse=True, fresh=fresh)
            touched = np.flatnonzero(np.bincount(tokens.ravel(), minlength=1))
            done += 1
            norm = np.sqrt(sum(float(np.vdot(g, g)) for g in grads.values())) / count
            scale = np.float32(min(1.0, CLIP / max(norm, 1e-12)) / count)
            for k, g in grads.items():
                if k != "input":
                    for own in _pieces(self.p[k], first[k], second[k], g):
                        _adam(*own, scale, rate, done)
                    continue
                value, one, two = (x.take(touched, axis=0) for x in (self.p[k], first[k], second[k]))
                _adam(value, one, two, g, scale, rate, done)
                self.p[k][touched], first[k][touched], second[k][touched] = value, one, two

    def score(self, documents: list[np.ndarray], window=2 * WINDOW, lanes=SCORE_LANES) -> np.ndarray:
        """Natural log likelihood of each whole document; the state goes on from window to window."""
        out, state, given = np.zeros(len(documents)), None, self.inputs()
        for tokens, live, owner in windows(documents, window, lanes, owners=True):
            state = np.zeros((tokens.shape[1], self.units), np.float32) if state is None else state[: tokens.shape[1]]
            states, state, _ = self.forward(tokens, state, given=given)
            own = live.ravel()
            got = self.log_probability(states.reshape(-1, self.units)[own], tokens.ravel()[own])
            np.add.at(out, owner.ravel()[own], got)
        return out


def _rooms(sizes: np.ndarray, classes: int) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Rows that each class is given, of which it needs ``sizes``, and runs of classes with equally many.

    Rows cost less than calls: of ``JOINED`` neighbours with few rows each has as many as the largest.
    """
    rooms, joined = sizes.copy(), []
    for c in range(0, classes, JOINED):
        d = min(c + JOINED, classes)
        most = int(sizes[c:d].max())
        if 0 < most <= FEW and most * (d - c) <= ROWS and d - c > 1:
            rooms[c:d] = most
            joined.append((c, d))
    return rooms, joined


def _split(rows: np.ndarray, parts: int) -> np.ndarray:
    return rows.reshape(parts, -1, rows.shape[-1])


def _blocks(edges: np.ndarray, joined=()):
    """Lists of ``table, end of tables, from, to`` that follow each other, of at most ``ROWS`` rows each."""
    parts, held, ends, edges = [], 0, dict(joined), edges.tolist()
    c = 0
    while c < len(edges) - 1:
        d = ends.get(c, c + 1)
        x, y = edges[c], edges[d]
        if d - c > 1 and held + y - x > ROWS:
            yield parts
            parts, held = [], 0
        while x < y:
            step = min(y - x, ROWS - held)
            parts.append((c, d, x, x + step))
            x, held = x + step, held + step
            if held == ROWS:
                yield parts
                parts, held = [], 0
        c = d
    if parts:
        yield parts


def _short(numbers: np.ndarray, end: int) -> np.ndarray:
    """``numbers`` below ``end`` in as few bytes as hold them: two bytes are sorted much faster than eight."""
    return numbers.astype(np.uint16) if end <= 1 << 16 else numbers


def _summed(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different ``rows``, in order, and the sums of their ``values``."""
    order = np.argsort(rows, kind="stable")
    rows, values = rows[order], values.take(order, axis=0)
    starts = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
    sizes = np.diff(np.append(starts, len(rows)))
    sums, ones = values.take(starts, axis=0), np.ones(sizes.max(initial=0), values.dtype)
    many = np.flatnonzero(sizes >= MANY)
    for k, at, size in zip(many.tolist(), starts[many].tolist(), sizes[many].tolist(), strict=True):
        np.matmul(ones[:size], values[at : at + size], out=sums[k])
    # The second values of rows with few, then the third and so on.
    few = np.flatnonzero((sizes > 1) & (sizes < MANY))
    for n in range(1, MANY - 1):
        sums[few] += values.take(starts[few] + n, axis=0)
        few = few[sizes[few] > n + 1]
    return rows[starts], sums


def _pieces(*arrays: np.ndarray):
    """Views of arrays of one shape, in pieces that stay in a core's cache."""
    flat = [a.reshape(-1) for a in arrays]
    for at in range(0, flat[0].size, PIECE):
        yield [f[at : at + PIECE] for f in flat]


def _adam(value, one, two, g, scale, rate, done):
    """Step ``done`` of Adam in place by the gradient ``g * scale``; ``g`` is used up.

    ``one`` and ``two`` add up ``g`` and its square, each sum fading by 0.9 and 0.999: means but for a factor.
    """
    root = np.sqrt(0.001 / (1 - 0.999**done))
    by = rate * 0.1 / (1 - 0.9**done)
    g *= scale
    one *= 0.9
    one += g
    two *= 0.999
    g *= g
    two += g
    np.sqrt(two, out=g)
    g *= root / by
    g += 1e-8 / by
    np.divide(one, g, out=g)
    value += g


def windows(documents: list[np.ndarray], window: int, lanes: int, owners=False, starts=False):
    """Windows (time, lane) over documents laid end to end in lanes of about equal length, longest first.

    Yields tokens, which of them are real, and with ``starts`` which begin a document or with ``owners`` the number of their document.  Lanes that have ended
    are left out: the others come first.  With ``owners``, windows get longer as lanes get fewer.
    """
    sizes = np.array([len(d) for d in documents], np.int64)
    if not sizes.sum():
        return
    lanes = int(min(lanes, len(documents)))
    order, load = np.argsort(-sizes, kind="stable"), [(0, k) for k in range(lanes)]
    held = [[] for _ in range(lanes)]
    heapify(load)
    for d in order:
        total, k = heappop(load)
        held[k].append(d)
        heappush(load, (total + int(sizes[d]), k))
    lengths = np.array([sum(sizes[d] for d in own) for own in held], np.int64)
    ranks = np.argsort(-lengths, kind="stable")
    laid, lengths = [d for k in ranks for d in held[k]], lengths[ranks]
    flat, begins = np.concatenate([documents[d] for d in laid]), np.cumsum(lengths) - lengths
    if owners:
        marks = np.repeat(np.array(laid, np.int32), sizes[laid])
    elif starts:
        marks = np.zeros(len(flat), bool)
        marks[(np.cumsum(sizes[laid]) - sizes[laid])[sizes[laid] > 0]] = True
    at, longest = 0, int(lengths[0])
    while at < longest:
        active = int(np.searchsorted(-lengths, -at))
        steps = min(max(window, min(LONGEST, window * lanes // active)), longest - at) if owners else window
        places = np.arange(at, at + steps)[:, None]
        live = places < lengths[:active]
        places = np.minimum(places + begins[:active], len(flat) - 1)
        tokens = flat.take(places).astype(np.int64)
        tokens *= live
        if owners or starts:
            mark = marks.take(places)
            mark *= live
            yield tokens, live, mark
        else:
            yield tokens, live
        at += steps
