"""PII spans: patterns, and a character-level bidirectional LSTM with CRF transitions.

Base spans are e-mail addresses, IP addresses, card numbers and phone numbers by pattern.
On labelled spans (windows of texts with their base spans) a small BiLSTM-CRF is trained in
numpy; it reads whole texts in overlapping windows and labels characters.  Windows are
reconciled over the whole text: each character takes the label of the window in which it
lies most centrally, then neighbouring characters of one kind form a span, however many
windows it crosses.  A decoded span that touches no base span and holds what its kind needs
is added; base spans stay as they are.

All four kinds need a digit or an `@`; a window without either holds no span and is not
decoded.  At most `TRAIN_TEXTS` texts, the first by hash of the id, and `TRAIN_WINDOWS`
windows train the network, on the driver, with a fixed seed.

Null and empty texts have no spans.  Repeated rows repeat; an empty table stays empty; without
training windows there are only base spans.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from closeline.llm.common import checkpointed, first_by, joined

KINDS = ("email", "ip", "card", "phone")
#: Characters a window shows, and how far the next one is.
WINDOW, STEP = 64, 32
TRAIN_TEXTS, TRAIN_WINDOWS = 2000, 4000
EMBEDDING, HIDDEN, STEPS, BATCH, RATE = 12, 16, 160, 48, 0.02
#: Windows decoded together.
DECODED = 512
#: O, then B and I of every kind.
LABELS = 1 + 2 * len(KINDS)
#: Padding, ASCII, other letters, all else.
CHARACTERS = 131

Span = tuple[str, int, int]

DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
SIGNAL = re.compile(r"[0-9@]")


def _emails(text: str) -> Iterator[Span]:
    """Leftmost matches: from each `@`, back over the local part, on over the domain."""
    free = 0
    for domain in DOMAIN.finditer(text):
        start = domain.start()
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        if start < domain.start():
            free = domain.end()
            yield "email", start, free


def _luhn(digits: str) -> bool:
    doubled = (sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (sum(map(int, digits[-1::-2])) + sum(doubled)) % 10 == 0


def base_spans(text: str | None) -> list[Span]:
    """The patterns' spans, by kind, then start."""
    if not text or not SIGNAL.search(text):
        return []
    found = list(_emails(text)) if "@" in text else []
    for m in IP.finditer(text):
        parts = [part.lstrip("0") or "0" for part in m.group().split(".")]
        if all(len(part) <= 3 and int(part) <= 255 for part in parts):
            found.append(("ip", m.start(), m.end()))
    for m in CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and _luhn(digits):
            found.append(("card", m.start(), m.end()))
    for m in PHONE.finditer(text):
        if 8 <= sum(c in "0123456789" for c in m.group()) <= 15:
            found.append(("phone", m.start(), m.end()))
    return found


def encoded(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    return np.where(codes < 128, codes + 1, np.where(codes < 0x2000, 129, 130))


def label_ids(spans: list[Span], length: int) -> np.ndarray:
    out = np.zeros(length, dtype=np.int64)
    for kind, start, end in spans:
        out[start:end] = 2 + 2 * KINDS.index(kind)
        out[start] -= 1
    return out


def starts(text: str) -> list[int]:
    """Starts of the overlapping windows that show a digit or an `@`."""
    last = max(0, len(text) - WINDOW)
    near = set()
    for m in SIGNAL.finditer(text):
        first = max(0, (m.start() - WINDOW) // STEP + 1)
        near.update(range(first * STEP, m.start() + 1, STEP))
    return sorted({min(s, last) for s in near})


def window_rows(codes: np.ndarray, at: list[int]) -> np.ndarray:
    padded = codes if len(codes) >= WINDOW else np.pad(codes, (0, WINDOW - len(codes)))
    return np.stack([padded[s : s + WINDOW] for s in at])


# ---- network ---------------------------------------------------------------

Weights = dict[str, np.ndarray]


def initial(rng: np.random.Generator) -> Weights:
    def normal(*shape: int) -> np.ndarray:
        return rng.normal(0, 1 / np.sqrt(shape[0]), shape)

    w = {"embedding": rng.normal(0, 0.5, (CHARACTERS, EMBEDDING))}
    for side in "fb":
        w[f"in_{side}"], w[f"state_{side}"] = normal(EMBEDDING, 4 * HIDDEN), normal(HIDDEN, 4 * HIDDEN)
        w[f"bias_{side}"] = np.repeat([0.0, 1.0, 0.0, 0.0], HIDDEN)
    w["out"], w["out_bias"] = normal(2 * HIDDEN, LABELS), np.zeros(LABELS)
    w["first"], w["next"] = np.zeros(LABELS), np.zeros((LABELS, LABELS))
    return w


def _lstm(x: np.ndarray, w: Weights, side: str) -> tuple[np.ndarray, list]:
    """Hidden states of (batch, time, 4 * HIDDEN) gate inputs, in time order of `x`."""
    batch, time = x.shape[:2]
    h, c = np.zeros((batch, HIDDEN), x.dtype), np.zeros((batch, HIDDEN), x.dtype)
    states, cache = np.empty((batch, time, HIDDEN), x.dtype), []
    for t in range(time):
        z = x[:, t] + h @ w[f"state_{side}"]
        gates = 0.5 + 0.5 * np.tanh(0.5 * z[:, : 3 * HIDDEN])
        i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
        g = np.tanh(z[:, 3 * HIDDEN :])
        before, c_before = h, c
        c = f * c + i * g
        squashed = np.tanh(c)
        h = o * squashed
        states[:, t] = h
        cache.append((i, f, o, g, squashed, before, c_before))
    return states, cache


def _lstm_back(d_states: np.ndarray, cache: list, w: Weights, side: str, grad: Weights) -> np.ndarray:
    batch, time, _ = d_states.shape
    dh, dc = np.zeros((batch, HIDDEN)), np.zeros((batch, HIDDEN))
    d_x = np.empty((batch, time, 4 * HIDDEN))
    for t in reversed(range(time)):
        i, f, o, g, squashed, before, c_before = cache[t]
        dh = dh + d_states[:, t]
        dc = dc + dh * o * (1 - squashed**2)
        parts = (dc * g * i * (1 - i), dc * c_before * f * (1 - f), dh * squashed * o * (1 - o), dc * i * (1 - g**2))
        dz = np.concatenate(parts, axis=1)
        d_x[:, t] = dz
        grad[f"state_{side}"] += before.T @ dz
        dh, dc = dz @ w[f"state_{side}"].T, dc * f
    return d_x


def emissions(ids: np.ndarray, w: Weights) -> tuple[np.ndarray, tuple]:
    x = w["embedding"][ids]
    forward, cache_f = _lstm(x @ w["in_f"] + w["bias_f"], w, "f")
    backward, cache_b = _lstm(x[:, ::-1] @ w["in_b"] + w["bias_b"], w, "b")
    states = np.concatenate([forward, backward[:, ::-1]], axis=2)
    return states @ w["out"] + w["out_bias"], (x, states, cache_f, cache_b)


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def loss_and_gradient(ids: np.ndarray, labels: np.ndarray, w: Weights) -> tuple[float, Weights]:
    """Mean negative log-likelihood of the labels under the CRF, and its gradient."""
    scores, (x, states, cache_f, cache_b) = emissions(ids, w)
    batch, time, _ = scores.shape
    grad = {k: np.zeros_like(v) for k, v in w.items()}
    alpha, beta = np.empty_like(scores), np.zeros_like(scores)
    alpha[:, 0] = w["first"] + scores[:, 0]
    for t in range(1, time):
        alpha[:, t] = _log_sum(alpha[:, t - 1, :, None] + w["next"], 1) + scores[:, t]
    for t in reversed(range(time - 1)):
        beta[:, t] = _log_sum(w["next"] + (scores[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
    log_z = _log_sum(alpha[:, -1], 1)
    rows, places = np.arange(batch)[:, None], np.arange(time)
    gold = scores[rows, places, labels].sum() + w["first"][labels[:, 0]].sum()
    gold += w["next"][labels[:, :-1], labels[:, 1:]].sum()
    d_scores = np.exp(alpha + beta - log_z[:, None, None])
    grad["first"] = d_scores[:, 0].sum(0)
    np.subtract.at(grad["first"], labels[:, 0], 1)
    for t in range(time - 1):
        pair = alpha[:, t, :, None] + w["next"] + (scores[:, t + 1] + beta[:, t + 1])[:, None, :]
        grad["next"] += np.exp(pair - log_z[:, None, None]).sum(0)
    np.subtract.at(grad["next"], (labels[:, :-1], labels[:, 1:]), 1)
    d_scores[rows, places, labels] -= 1
    grad["out"] = np.einsum("bth,btk->hk", states, d_scores)
    grad["out_bias"] = d_scores.sum((0, 1))
    d_states = d_scores @ w["out"].T
    d_f = _lstm_back(d_states[:, :, :HIDDEN], cache_f, w, "f", grad)
    d_b = _lstm_back(d_states[:, ::-1, HIDDEN:], cache_b, w, "b", grad)
    grad["in_f"], grad["bias_f"] = np.einsum("bte,btk->ek", x, d_f), d_f.sum((0, 1))
    grad["in_b"], grad["bias_b"] = np.einsum("bte,btk->ek", x[:, ::-1], d_b), d_b.sum((0, 1))
    d_x = d_f @ w["in_f"].T + (d_b @ w["in_b"].T)[:, ::-1]
    np.add.at(grad["embedding"], ids, d_x)
    return float(log_z.sum() - gold) / batch, {k: g / batch for k, g in grad.items()}


def trained(ids: np.ndarray, labels: np.ndarray, steps: int = STEPS, seed: int = 7) -> Weights:
    """Weights after `steps` steps of Adam over random batches."""
    rng = np.random.default_rng(seed)
    w = initial(rng)
    mean = {k: np.zeros_like(v) for k, v in w.items()}
    square = {k: np.zeros_like(v) for k, v in w.items()}
    for step in range(1, steps + 1):
        chosen = rng.integers(0, len(ids), BATCH)
        _, grad = loss_and_gradient(ids[chosen], labels[chosen], w)
        rate = RATE * min(1.0, 2 * (1 - step / (steps + 1)))
        for k, g in grad.items():
            mean[k] = 0.9 * mean[k] + 0.1 * g
            square[k] = 0.99 * square[k] + 0.01 * g * g
            unbiased = mean[k] / (1 - 0.9**step), square[k] / (1 - 0.99**step)
            w[k] = w[k] - rate * unbiased[0] / (np.sqrt(unbiased[1]) + 1e-8)
    return w


def best_paths(ids: np.ndarray, w: Weights) -> np.ndarray:
    """The likeliest labels of every window."""
    scores, _ = emissions(ids, w)
    batch, time, _ = scores.shape
    back = np.empty((batch, time, LABELS), dtype=np.int64)
    total = w["first"] + scores[:, 0]
    for t in range(1, time):
        pair = total[:, :, None] + w["next"]
        back[:, t] = pair.argmax(1)
        total = pair.max(1) + scores[:, t]
    path = np.empty((batch, time), dtype=np.int64)
    path[:, -1] = total.argmax(1)
    for t in reversed(range(1, time)):
        path[:, t - 1] = back[np.arange(batch), t, path[:, t]]
    return path


# ---- reconciling -------------------------------------------------------------


def reconciled(length: int, at: list[int], paths: Iterable[np.ndarray]) -> np.ndarray:
    """Labels of a text: each character as its most central window has it, else 0."""
    labels, depth = np.zeros(length, dtype=np.int8), np.full(length, -1, dtype=np.int8)
    place = np.arange(WINDOW)
    central = np.minimum(place, WINDOW - 1 - place)
    for s, path in zip(at, paths):
        end = min(length, s + WINDOW)
        better = central[: end - s] > depth[s:end]
        labels[s:end][better] = path[: end - s][better]
        depth[s:end][better] = central[: end - s][better]
    return labels


def decoded_spans(labels: np.ndarray) -> list[Span]:
    """Runs of one kind, broken where a new span begins."""
    found: list[Span] = []
    for place in np.flatnonzero(labels).tolist():
        kind, begins = KINDS[(labels[place] - 1) // 2], labels[place] % 2 == 1
        if found and not begins and found[-1][0] == kind and found[-1][2] == place:
            found[-1] = (kind, found[-1][1], place + 1)
        else:
            found.append((kind, place, place + 1))
    return found


def holds(kind: str, part: str) -> bool:
    """What a decoded span of a kind must hold."""
    digits = sum(c in "0123456789" for c in part)
    if kind == "email":
        return "@" in part[1:-1] and not any(c.isspace() for c in part)
    if kind == "ip":
        return part.count(".") == 3 and 4 <= digits <= 12
    return 13 <= digits <= 19 if kind == "card" else 8 <= digits <= 15


def all_spans(text: str, base: list[Span], labels: np.ndarray) -> list[Span]:
    """Base spans and the decoded spans that touch none, by kind, then start."""
    taken = np.zeros(len(text) + 1, dtype=bool)
    for _, start, end in base:
        taken[start:end] = True
    added = [s for s in decoded_spans(labels) if not taken[s[1] : s[2]].any() and holds(s[0], text[s[1] : s[2]])]
    return sorted(base + added, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def decoded(texts: list[str], w: Weights) -> Iterator[np.ndarray]:
    """Labels of each text's characters.

    Windows of all texts are decoded `DECODED` at a time; of the others of a text, only
    their labels, a byte a character, are held.
    """
    w = {k: v.astype(np.float32) for k, v in w.items()}
    rows: list[np.ndarray] = []
    waiting: list[tuple[int, list[int], list[np.ndarray]]] = []
    held = 0

    def decode() -> np.ndarray:
        paths = best_paths(np.concatenate(rows), w).astype(np.int8)
        rows.clear()
        return paths

    def hand_out(paths: np.ndarray) -> None:
        done = 0
        for _, at, parts in waiting:
            missing = len(at) - sum(map(len, parts))
            parts.append(paths[done : done + missing])
            done += len(parts[-1])

    for text in texts:
        at = starts(text) if text else []
        waiting.append((len(text), at, []))
        codes = encoded(text) if at else None
        place = 0
        while place < len(at):
            part = at[place : place + DECODED - held]
            rows.append(window_rows(codes, part))
            place, held = place + len(part), held + len(part)
            if held == DECODED:
                hand_out(decode())
                held = 0
        if not held:
            yield from (reconciled(n, at, itertools.chain(*parts)) for n, at, parts in waiting)
            waiting.clear()
    if held:
        hand_out(decode())
    yield from (reconciled(n, at, itertools.chain(*parts)) for n, at, parts in waiting)


def spans_of(texts: list[str], w: Weights | None) -> list[tuple[list[Span], list[Span]]]:
    """(base, all) spans of each text."""
    if w is None:
        return [(base, base) for base in map(base_spans, texts)]
    out = []
    for text, labels in zip(texts, decoded(texts, w)):
        base = base_spans(text)
        out.append((base, all_spans(text, base, labels)))
    return out


def fitted(docs: DataFrame) -> Weights | None:
    """Weights trained on a bounded sample of windows, or None without windows."""
    texts = docs.select("doc_id", "text").where(F.col("text").rlike("[0-9@]"))
    texts = texts.withColumn("text_hash", F.xxhash64("text"))
    key = ["doc_id", "text_hash"]
    # Texts are chosen by hash before they are fetched.
    first = first_by(checkpointed(texts.select(key).distinct()), key, TRAIN_TEXTS)
    sample = joined(texts, F.broadcast(first), key, "left_semi").dropDuplicates(key).select("text")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for text in batch["text"]:
                labels = label_ids(base_spans(text), len(text))
                at = starts(text)
                at = at if len(at) <= 8 else [at[i * len(at) // 8] for i in range(8)]
                rows, marks = window_rows(encoded(text), at), window_rows(labels, at)
                yield pd.DataFrame({"ids": rows.tolist(), "labels": marks.tolist()})

    cuts = sample.mapInPandas(cut, "ids array<int>, labels array<int>")
    rows = cuts.orderBy(F.xxhash64("ids", "labels"), "ids", "labels").limit(TRAIN_WINDOWS).collect()
    if not rows:
        return None
    rows.sort()
    return trained(np.array([r.ids for r in rows]), np.array([r.labels for r in rows]))


def named(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def found(docs: DataFrame) -> DataFrame:
    """`docs` with n_email, n_ip, n_card, n_phone, base_sha256, spans and `redacted` text."""
    shared = docs.sparkSession.sparkContext.broadcast(fitted(docs))
    schema = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, redacted string"

    @F.pandas_udf(schema)
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [t or "" for t in batch]
            rows = []
            for text, (base, every) in zip(texts, spans_of(texts, shared.value)):
                counts = [sum(s[0] == kind for s in base) for kind in KINDS]
                digest = hashlib.sha256(named(base).encode()).hexdigest()
                rows.append((*counts, digest, named(every), redacted(text, every)))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    return docs.withColumn("_pii", find("text")).select(*docs.columns, "_pii.*")


def redacted(text: str, spans: list[Span]) -> str:
    """The text with every span, overlapping ones together, replaced by its kind."""
    out, done = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= done:
            out += [text[done:start], f"<{kind.upper()}>"]
        done = max(done, end)
    return "".join([*out, text[done:]])
