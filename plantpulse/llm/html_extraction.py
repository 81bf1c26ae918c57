"""Main text of pages by a linear-chain CRF over leaf blocks.

Blocks carry indicator features of their ancestors (tags, class and id words)
and of their text (length, links, punctuation).  Weights of features and of
label transitions are fitted by maximum likelihood on labelled pages with
forward-backward sums; pages are decoded by Viterbi, all pages of a batch side
by side.  The model is a few thousand numbers, whatever the corpus.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantpulse.llm import labelled_pages, textbuf
from plantpulse.llm.html_blocks import Block, Element, blocks

#: Labelled pages to fit on.
TRAINING_PAGES = 600


def _seen(e: Element | None, known) -> frozenset:
    """``in=`` and ``word=`` features of an element and its ancestors.

    Only those ``known``, where that is given, so that a set's size is bounded
    by the model's.  Elements that add nothing share their parent's set.
    """
    chain = []
    while e and e.known is None:
        chain.append(e)
        e = e.parent
    seen = e.known if e else frozenset()
    for e in reversed(chain):
        own = [f"in={e.tag}", *(f"word={w}" for w in e.words)]
        new = [f for f in own if f not in seen and (known is None or f in known)]
        e.known = seen = seen.union(new) if new else seen
    return seen


def _path_features(e: Element | None, known=None) -> tuple[str, ...]:
    if e is None:
        return ("depth=0",)
    if e.features is None:
        near = [(place, e) for place, e in (("near", e.named), ("next", e.named and e.named.parent and e.named.parent.named)) if e]
        e.features = (*sorted(_seen(e, known)), *sorted({f"{place}={w}" for place, x in near for w in x.words}), f"own={e.tag}", f"depth={min(e.depth, 8)}")
    return e.features


def _text_features(b: Block) -> tuple[str, ...]:
    n = b.text.count(" ") + 1
    share = b.linked / len(b.text)
    return (
        "bias", f"words={min(n.bit_length(), 8)}", f"links={0 if share == 0 else 1 if share < 0.5 else 2}", f"ends={'.' if b.text[-1] in '.!?' else ',' if b.text[-1] in ',;:' else ''}",
        f"stops={min(b.text.count('. ').bit_length(), 3)}", f"copyright={'©' in b.text}", f"links,words={share > 0.5},{min(n.bit_length(), 5)}",
    )


def features(page: list[Block], known=None) -> list[tuple[str, ...]]:
    """Features of each block; of its ancestors only those ``known``, if given."""
    return [_path_features(b.element, known) + _text_features(b) for b in page]


@dataclass(frozen=True)
class Model:
    """``weights``: a row of two label scores for each feature."""

    index: dict
    weights: np.ndarray
    transitions: np.ndarray
    first: np.ndarray

    def emissions(self, pages: list[list[tuple[str, ...]]]) -> np.ndarray:
        """Label scores of all pages' blocks in a row; unknown features count nothing."""
        get = self.index.get
        ids, sizes = [], []
        for page in pages:
            for block in page:
                known = [i for f in block if (i := get(f)) is not None]
                ids.extend(known)
                sizes.append(len(known))
        if not sizes:
            return np.zeros((0, 2))
        total = np.concatenate([np.zeros((1, 2)), np.cumsum(self.weights[ids], 0)]) if ids else np.zeros((1, 2))
        ends = np.cumsum(sizes)
        return total[ends] - total[ends - sizes]

    def viterbi(self, scores: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The best labels of every page, in a row."""
        e, mask = _padded(scores, lengths)
        lanes, steps = mask.shape
        back = np.zeros((steps, lanes, 2), np.int8)
        best = e[:, 0] + self.first if steps else np.zeros((lanes, 2))
        for t in range(1, steps):
            paths = best[:, :, None] + self.transitions
            back[t] = paths.argmax(1)
            best = np.where(mask[:, t, None], paths.max(1) + e[:, t], best)
            back[t][~mask[:, t]] = [0, 1]
        label = best.argmax(1)
        out = np.zeros((lanes, steps), np.int8)
        for t in range(steps - 1, -1, -1):
            out[:, t] = label
            label = back[t][np.arange(lanes), label] if t else label
        return out[mask]


def _padded(scores: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mask = np.arange(int(lengths.max()) if len(lengths) else 0) < lengths[:, None]
    e = np.zeros((*mask.shape, scores.shape[1]))
    e[mask] = scores
    return e, mask


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


@dataclass(frozen=True)
class _Examples:
    """Labelled pages as arrays: block features (each block has some), truth, lengths, label pairs."""

    ids: np.ndarray
    sizes: np.ndarray
    width: int
    truth: np.ndarray
    lengths: np.ndarray
    starts: np.ndarray
    pairs: np.ndarray


def _examples(pages, labels, index) -> _Examples:
    found = [[index[f] for f in set(b)] for p in pages for b in p]
    ids, sizes = np.array([i for b in found for i in b]), np.array([len(b) for b in found])
    y = np.array([v for p in labels for v in p])
    lengths = np.array([len(p) for p in pages])
    starts = np.cumsum(lengths) - lengths
    truth = np.zeros((len(y), 2))
    truth[np.arange(len(y)), y] = 1
    inner = np.ones(len(y), bool)
    inner[starts] = False
    pairs = np.zeros((2, 2))
    np.add.at(pairs, (y[np.flatnonzero(inner) - 1], y[inner]), 1)
    return _Examples(ids, sizes, len(index), truth, lengths, starts, pairs)


def objective(params, data: _Examples, penalty: float) -> tuple[float, list[np.ndarray]]:
    """Penalised log likelihood of the labels, and its slopes, by forward-backward sums."""
    weights, trans, first = params
    scores = np.add.reduceat(weights[data.ids], np.cumsum(data.sizes) - data.sizes)
    e, mask = _padded(scores, data.lengths)
    lanes, steps = mask.shape
    ahead, behind = np.zeros((steps, lanes, 2)), np.zeros((steps, lanes, 2))
    ahead[0] = e[:, 0] + first
    for t in range(1, steps):
        ahead[t] = np.where(mask[:, t, None], _log_sum(ahead[t - 1][:, :, None] + trans, 1) + e[:, t], ahead[t - 1])
    total = _log_sum(ahead[-1], 1)
    expected = np.zeros((2, 2))
    for t in range(steps - 1, 0, -1):
        on = mask[:, t]
        joint = ahead[t - 1][:, :, None] + trans + (e[:, t] + behind[t])[:, None, :] - total[:, None, None]
        expected += np.exp(joint[on]).sum(0)
        behind[t - 1] = np.where(on[:, None], _log_sum(trans + (e[:, t] + behind[t])[:, None, :], 2), behind[t])
    share = np.exp(ahead + behind - total[None, :, None]).transpose(1, 0, 2)[mask]
    n = len(data.truth)
    value = (data.truth * scores).sum() + (data.pairs * trans).sum() + (data.truth[data.starts] * first).sum() - total.sum()
    value -= penalty / 2 * (n * (weights**2).sum() + (trans**2).sum())
    gap = np.repeat(data.truth - share, data.sizes, 0)
    towards = np.stack([np.bincount(data.ids, gap[:, y], minlength=data.width) for y in range(2)], 1)
    slopes = [towards - penalty * n * weights, data.pairs - expected - penalty * trans, (data.truth - share)[data.starts].sum(0)]
    return float(value), slopes


def train(pages: list[list[tuple[str, ...]]], labels: list[list[int]], rounds: int = 80, rate: float = 0.7, penalty: float = 3e-5) -> Model:
    """Fit by gradient ascent on the conditional likelihood."""
    kept = [i for i, p in enumerate(pages) if p]
    pages, labels = [pages[i] for i in kept], [labels[i] for i in kept]
    index = {f: i for i, f in enumerate(sorted({f for p in pages for b in p for f in b}))}
    data = _examples(pages, labels, index)
    params = [np.zeros((len(index), 2)), np.zeros((2, 2)), np.zeros(2)]
    seen = [np.full_like(p, 1e-8) for p in params]
    for _ in range(rounds):
        _, slopes = objective(params, data, penalty)
        for p, g, s in zip(params, slopes, seen):  # AdaGrad
            s += g * g
            p += rate * g / np.sqrt(s)
    return Model(index, *params)


@lru_cache(4)
def default_model(n: int = TRAINING_PAGES) -> Model:
    """The model of the first ``n`` labelled pages."""
    made = [labelled_pages.page(i) for i in range(n)]
    pages = [features(blocks(h)) for h, _ in made]
    good = [i for i, p in enumerate(pages) if len(p) == len(made[i][1])]
    return train([pages[i] for i in good], [made[i][1] for i in good])


def main_texts(htmls: list[str], model: Model) -> list[str]:
    pages = [blocks(h) for h in htmls]
    labels = model.viterbi(model.emissions([features(p, model.index) for p in pages]), np.array([len(p) for p in pages])).tolist()
    out, at = [], 0
    for p in pages:
        out.append(" ".join(b.text for b, label in zip(p, labels[at : at + len(p)]) if label))
        at += len(p)
    return out


def extract(pages: DataFrame, model: Model | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every row.

    Null or empty html, and pages without an article, give an empty text.
    Pages of any length and depth are read whole, in linear time.
    One row per input row, whatever its id or url; other columns are ignored;
    an empty table gives an empty result.
    """
    model = model or default_model()

    def run(batches):
        for b in textbuf.slices(batches, "html"):
            texts = main_texts([h or "" for h in b.column("html").to_pylist()], model)
            yield pa.record_batch([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
