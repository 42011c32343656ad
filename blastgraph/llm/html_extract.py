"""HTML extraction by a recurrent block labeller.

A page becomes the sequence of its leaf blocks. A bidirectional LSTM in numpy reads, for each
block, a vector of its tag path (hashed element, class, id and role names) and a vector of its
hashed words, and labels every block as main text or not with the whole page as context.

The network is trained here, on ``PAGES`` made-up pages (``html_pages``) with a fixed seed, once
for each driver process; it takes some seconds and the weights are a few hundred kB, which go to the
tasks with the code. No row of ``pages`` is used for training.

Memory of a task is that of one page's blocks plus ``STEP_CELLS`` feature vectors: short pages go
through the network together, a longer page goes through it in stretches, once in each direction,
with the states carried from stretch to stretch, which gives the same labels.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_limits, pick
from .html_blocks import PLACES, Block, blocks
from .html_pages import Maker

PATH_DIM, WORD_DIM, MORE_DIM, HIDDEN = 2 * PLACES, 48, 6, 24
PAGES, EPOCHS, BATCH, SEED = 1500, 10, 24, 11
#: Blocks, padding included, whose vectors and states are held at once.
STEP_CELLS = 20_000
SIGNS = re.compile("[\ue000\ue001]")


@lru_cache(200_000)
def _word_place(word: str) -> int:
    return zlib.crc32(word.encode()) % WORD_DIM


@lru_cache(50_000)
def _path_vector(bits: int, last: tuple[str, ...]) -> np.ndarray:
    """Names anywhere on the path in one half, the innermost ``INNERMOST`` in the other."""
    v = np.zeros(PATH_DIM, np.float32)
    v[:PLACES] = np.unpackbits(np.frombuffer(bits.to_bytes(PLACES // 8, "little"), np.uint8), bitorder="little")
    for name in last:
        v[PLACES + zlib.crc32(name.encode(), 7) % PLACES] = 1
    return v


def vectors(page: list[Block], start: int = 0, end: int | None = None) -> np.ndarray:
    """Vectors of the blocks from ``start`` to ``end`` of a page."""
    end = len(page) if end is None else end
    x = np.zeros((end - start, PATH_DIM + WORD_DIM + MORE_DIM), np.float32)
    for i, b in enumerate(page[start:end]):
        words = b.text.lower().split()
        x[i, :PATH_DIM] = _path_vector(b.at.bits, b.at.last) if b.at else 0
        counts = np.bincount([_word_place(w) for w in words], minlength=WORD_DIM)
        x[i, PATH_DIM : PATH_DIM + WORD_DIM] = counts / np.sqrt((counts * counts).sum())
        letters = sum(map(str.isalpha, b.text))
        x[i, -MORE_DIM:] = (np.log1p(len(b.text)) / 5, np.log1p(len(words)) / 3, b.linked, letters / len(b.text), (start + i + 1) / len(page), np.log1p(len(page)) / 4)
    return x


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-z))


class Labeller:
    """A bidirectional LSTM with a logistic output for each step."""

    def __init__(self, weights: dict[str, np.ndarray] | None = None):
        if weights is None:
            r = np.random.default_rng(SEED)
            n = PATH_DIM + WORD_DIM + MORE_DIM
            weights = {"out": r.normal(0, 0.2, 2 * HIDDEN).astype(np.float32), "bias": np.zeros(1, np.float32)}
            for d in "fb":
                weights[f"x{d}"] = r.normal(0, 1 / np.sqrt(n), (n, 4 * HIDDEN)).astype(np.float32)
                weights[f"h{d}"] = r.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, 4 * HIDDEN)).astype(np.float32)
                weights[f"c{d}"] = np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)]).astype(np.float32)
        self.w = weights

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str, keep: bool, state=None):
        """x: steps, pages, features; mask: steps, pages. Hidden states by step, what training needs,
        and the state at the end of the direction, which a longer page's next stretch starts from."""
        steps, pages, _ = x.shape
        z = x @ self.w[f"x{d}"] + self.w[f"c{d}"]
        h, c = state or (np.zeros((pages, HIDDEN), np.float32), np.zeros((pages, HIDDEN), np.float32))
        out, saved = np.zeros((steps, pages, HIDDEN), np.float32), []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            a = z[t] + h @ self.w[f"h{d}"]
            gates = _sigmoid(a[:, : 3 * HIDDEN])
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            g, m = np.tanh(a[:, 3 * HIDDEN :]), mask[t][:, None]
            new = f * c + i * g
            tanh = np.tanh(new)
            if keep:
                saved.append((t, h, c, i, f, o, g, tanh, m))
            c = np.where(m, new, c)
            h = np.where(m, o * tanh, h)
            out[t] = h
        return out, saved, (h, c)

    def forward(self, x: np.ndarray, mask: np.ndarray, keep: bool = False):
        both = [self._run(x, mask, d, keep) for d in "fb"]
        h = np.concatenate([b[0] for b in both], axis=2)
        return _sigmoid(h @ self.w["out"] + self.w["bias"]), h, [b[1] for b in both]

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, h, saved = self.forward(x, mask, keep=True)
        dz = np.where(mask, p - y, 0).astype(np.float32) / mask.sum()
        grads = {"out": (h * dz[:, :, None]).sum((0, 1)), "bias": dz.sum(keepdims=True).reshape(1)}
        for d, steps, part in (("f", saved[0], slice(0, HIDDEN)), ("b", saved[1], slice(HIDDEN, None))):
            gx, gh = np.zeros_like(self.w[f"x{d}"]), np.zeros_like(self.w[f"h{d}"])
            gc = np.zeros_like(self.w[f"c{d}"])
            dh = np.zeros((x.shape[1], HIDDEN), np.float32)
            dc = np.zeros_like(dh)
            for t, h0, c0, i, f, o, g, tanh, m in reversed(steps):
                dh = dh + dz[t][:, None] * self.w["out"][part]
                inner = np.where(m, dh, 0)
                dcell = np.where(m, dc, 0) + inner * o * (1 - tanh * tanh)
                da = np.concatenate([dcell * g * i * (1 - i), dcell * c0 * f * (1 - f), inner * tanh * o * (1 - o), dcell * i * (1 - g * g)], axis=1)
                gx += x[t].T @ da
                gh += h0.T @ da
                gc += da.sum(0)
                dh = np.where(m, da @ self.w[f"h{d}"].T, dh)
                dc = np.where(m, dcell * f, dc)
            grads |= {f"x{d}": gx, f"h{d}": gh, f"c{d}": gc}
        return grads

    def label(self, pages: list[list[Block]]) -> list[np.ndarray]:
        """Probability of main text of every block of every page; pages of like length go together."""
        out: list[np.ndarray] = [np.zeros(0, np.float32)] * len(pages)
        order = sorted((i for i in range(len(pages)) if len(pages[i])), key=lambda i: len(pages[i]))
        at = 0
        while at < len(order) and len(pages[order[at]]) <= STEP_CELLS:
            end = at + 1
            while end < len(order) and len(pages[order[end]]) * (end + 1 - at) <= STEP_CELLS:
                end += 1
            group = order[at:end]
            x, mask = padded([vectors(pages[i]) for i in group])
            p = self.forward(x, mask)[0]
            for k, i in enumerate(group):
                out[i] = p[: len(pages[i]), k]
            at = end
        for i in order[at:]:
            out[i] = self.label_long(pages[i])
        return out

    def label_long(self, page: list[Block], stretch: int = STEP_CELLS) -> np.ndarray:
        """As ``label`` for one page, of which only a stretch of vectors and states is held at once."""
        logits = np.full(len(page), self.w["bias"][0], np.float32)
        starts = range(0, len(page), stretch)
        for d, part, order in (("f", slice(0, HIDDEN), starts), ("b", slice(HIDDEN, None), reversed(starts))):
            state = None
            for at in order:
                x = vectors(page, at, min(at + stretch, len(page)))[:, None, :]
                h, _, state = self._run(x, np.ones(x.shape[:2], bool), d, False, state)
                logits[at : at + len(x)] += h[:, 0] @ self.w["out"][part]
        return _sigmoid(logits)


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(map(len, pages))
    x = np.zeros((steps, len(pages), pages[0].shape[1]), np.float32)
    mask = np.zeros((steps, len(pages)), bool)
    for k, p in enumerate(pages):
        x[: len(p), k], mask[: len(p), k] = p, True
    return x, mask


def made_page(seed: int) -> tuple[list[Block], np.ndarray]:
    """Blocks of a made-up page and their labels, from the signs in their texts."""
    page = [b for b in blocks(Maker(seed).page()) if SIGNS.search(b.text)]
    labels = np.array([SIGNS.search(b.text)[0] == "\ue001" for b in page], np.float32)
    return [Block(SIGNS.sub("", b.text) or "x", b.at, b.linked) for b in page], labels


@lru_cache(1)
def trained() -> Labeller:
    """Adam on the made-up pages, in an order and with a blanking of inputs that the seed fixes."""
    r, model = np.random.default_rng(SEED), Labeller()
    made = [(vectors(b), y) for b, y in map(made_page, range(PAGES)) if len(b)]
    first = {k: np.zeros_like(v) for k, v in model.w.items()}
    second = {k: np.zeros_like(v) for k, v in model.w.items()}
    made.sort(key=lambda m: len(m[0]))
    starts, step = list(range(0, len(made), BATCH)), 0
    for epoch in range(EPOCHS):
        for at in r.permutation(starts):
            part = made[at : at + BATCH]
            x, mask = padded([p for p, _ in part])
            y = np.zeros(mask.shape, np.float32)
            for k, (_, labels) in enumerate(part):
                y[: len(labels), k] = labels
            # Names and words that no page showed in training must not decide: blank some of them.
            x = x * np.where(r.random(x.shape[2]) < 0.06, 0, 1)[None, None, :].astype(np.float32)
            step += 1
            rate = 0.012 * 0.7**epoch
            for k, g in model.gradients(x, mask, y).items():
                g = np.clip(g, -1, 1)
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                model.w[k] = model.w[k] - (rate * first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return model


def _texts(weights: dict[str, np.ndarray]):
    def run(batches):
        model = Labeller(weights)

        def labelled(rows: list, pages: list[list[Block]]):
            texts = ["\n\n".join(b.text for b, p in zip(page, ps) if p >= 0.5) for page, ps in zip(pages, model.label(pages))]
            return pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array(texts, pa.string())], ["page_id", "url", "text"]
            )

        for batch in batches:
            rows, pages, cells = [], [], 0
            for i in range(batch.num_rows):  # one page is scanned at a time
                page = blocks(batch.column(2)[i].as_py())
                if rows and cells + len(page) > STEP_CELLS:
                    yield labelled(rows, pages)
                    rows, pages, cells = [], [], 0
                rows.append((batch.column(0)[i].as_py(), batch.column(1)[i].as_py()))
                pages.append(page)
                cells += len(page)
            if rows:
                yield labelled(rows, pages)

    return run


def main_text(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text (main blocks in page order, two line feeds between),
    n_chars. Null html counts as empty and gives an empty text; null and repeated ids and
    repeated rows are rows like any other; other columns are ignored; an empty table gives an
    empty result. Pages of any length and depth are labelled whole, and nothing of a main block is cut."""
    arrow_limits(pages.sparkSession)
    rows = pick(pages, "page_id", "url", "html").select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")
    )
    found = rows.mapInArrow(_texts(trained().w), "page_id long, url string, text string")
    return found.withColumn("n_chars", F.char_length("text").cast("long"))
