"""Language identification by a byte convolutional network.

Windows of ``WINDOW`` bytes of the UTF-8 text (A-Z lower-cased) go through a byte embedding, convolutions of several
widths, ReLU, max pooling over the window and a softmax. The network is small and is trained in NumPy on the driver,
on a sample of labelled documents of bounded size (``SAMPLE`` a language). It is applied to all windows of each whole
text, in workers: with the embedding folded into the filters, two neighbouring bytes are one look-up in a table of
65,536 rows a filter width, so a filter of width 6 is the sum of three rows. A document's probabilities are the means
over its windows, weighted by their bytes."""
from __future__ import annotations

import uuid
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from drawmark.llm.common import free_name, give_back, held

WINDOW, STRIDE = 256, 250
WIDTHS, FILTERS, EMBEDDED = (2, 4, 6), 16, 8
ABOVE_CHANCE = 0.1  # a document's language is accepted from here, between an even guess (0) and certainty (1)
SAMPLE = 2500  # documents of each language that the network learns from at most
SLICE_CHARS, EPOCHS, BATCH, RATE = 320, 6, 64, 0.01
UNKNOWN = "und"
_AT_ONCE = 128  # windows


@dataclass(frozen=True)
class Network:
    """Weights: ``embed`` (256, E), per width ``filters`` (width, E, F) and ``bias`` (F), ``dense`` (widths * F, languages), ``offset``."""
    languages: tuple[str, ...]
    embed: np.ndarray
    filters: tuple[np.ndarray, ...]
    bias: tuple[np.ndarray, ...]
    dense: np.ndarray
    offset: np.ndarray
    key: str = field(default_factory=lambda: uuid.uuid4().hex)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _crops(slices: list[bytes], rng: np.random.Generator) -> np.ndarray:
    """One window of each slice: at a random place, a third of them cut short, as last windows and short texts are."""
    out = np.zeros((len(slices), WINDOW), dtype=np.uint8)
    for row, s in zip(out, slices):
        size = min(len(s), WINDOW)
        if rng.random() < 0.34:
            size = min(size, int(rng.integers(12, WINDOW)))
        at = int(rng.integers(0, len(s) - size + 1))
        row[:size] = np.frombuffer(s[at:at + size], dtype=np.uint8)
    return out


def train(slices: list[bytes], labels: list[str], seed: int = 7, epochs: int = EPOCHS) -> Network | None:
    """Network for the languages in ``labels``; None without any. Adam on the cross entropy, languages weighted alike."""
    languages = tuple(sorted(set(labels)))
    if not languages:
        return None
    rng = np.random.default_rng(seed)
    y = np.array([languages.index(x) for x in labels])
    share = 1.0 / (np.bincount(y) * len(languages))
    shape = {"embed": (256, EMBEDDED), "dense": (len(WIDTHS) * FILTERS, len(languages)), "offset": (len(languages),)}
    for w in WIDTHS:
        shape |= {f"filter{w}": (w, EMBEDDED, FILTERS), f"bias{w}": (FILTERS,)}
    scale = {"embed": 0.5, "dense": 0.2, "offset": 0.0} | {f"filter{w}": (w * EMBEDDED) ** -0.5 for w in WIDTHS} | {f"bias{w}": 0.0 for w in WIDTHS}
    p = {k: (rng.standard_normal(s) * scale[k]).astype(np.float32) for k, s in shape.items()}
    p["embed"][0] = 0
    m, v, step = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}, 0
    for _ in range(epochs):
        windows = _crops(slices, rng)
        order = rng.permutation(len(slices))
        for begin in range(0, len(order), BATCH):
            rows = order[begin:begin + BATCH]
            x, target = windows[rows], y[rows]
            n, at = len(rows), np.arange(len(rows))[:, None]
            embedded = p["embed"][x]
            pooled, best = [], []
            for w in WIDTHS:
                places = np.lib.stride_tricks.sliding_window_view(embedded, w, axis=1).transpose(0, 1, 3, 2).reshape(n, WINDOW - w + 1, w * EMBEDDED)
                out = places @ p[f"filter{w}"].reshape(w * EMBEDDED, FILTERS)
                best.append(out.argmax(axis=1))
                pooled.append(np.take_along_axis(out, best[-1][:, None], axis=1)[:, 0] + p[f"bias{w}"])
            hidden = np.maximum(np.concatenate(pooled, axis=1), 0)
            probability = _softmax(hidden @ p["dense"] + p["offset"])
            wrong = probability.copy()
            wrong[np.arange(n), target] -= 1
            wrong *= (share[target] * len(y) / n)[:, None]
            g = {"dense": hidden.T @ wrong, "offset": wrong.sum(axis=0), "embed": np.zeros_like(p["embed"])}
            back = (wrong @ p["dense"].T) * (hidden > 0)
            for k, w in enumerate(WIDTHS):
                d = back[:, k * FILTERS:(k + 1) * FILTERS]
                seen = x[at[:, :, None], best[k][:, :, None] + np.arange(w)]  # (n, F, w) bytes under the pooled place
                g[f"filter{w}"] = np.einsum("nfwe,nf->wef", p["embed"][seen], d, optimize=True)
                g[f"bias{w}"] = d.sum(axis=0)
                np.add.at(g["embed"], seen.reshape(-1), (d[:, :, None, None] * p[f"filter{w}"].transpose(2, 0, 1)).reshape(-1, EMBEDDED))
            g["embed"][0] = 0
            step += 1
            for name, grad in g.items():
                m[name] += 0.1 * (grad - m[name])
                v[name] += 0.001 * (grad * grad - v[name])
                p[name] -= (RATE * (m[name] / (1 - 0.9 ** step)) / (np.sqrt(v[name] / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32)
    return Network(languages, p["embed"], tuple(p[f"filter{w}"] for w in WIDTHS), tuple(p[f"bias{w}"] for w in WIDTHS), p["dense"], p["offset"])


def _tables(net: Network) -> list[list[np.ndarray]]:
    """Per width, for each pair of taps the filters' responses to every pair of bytes."""
    out = []
    for filters in net.filters:
        taps = np.einsum("be,wef->wbf", net.embed, filters).astype(np.float32)
        out.append([(taps[t][:, None, :] + taps[t + 1][None, :, :]).reshape(1 << 16, FILTERS) for t in range(0, len(taps), 2)])
    return out


def window_probabilities(net: Network, tables: list[list[np.ndarray]], windows: np.ndarray) -> np.ndarray:
    """(windows, languages) from the bytes of windows as columns (WINDOW, windows)."""
    pairs = windows[:-1].astype(np.int32) << 8 | windows[1:]
    pooled = []
    for parts, bias in zip(tables, net.bias):
        n = WINDOW - 2 * len(parts) + 1
        out = np.take(parts[0], pairs[:n], axis=0)
        for t, part in enumerate(parts[1:], 1):
            out += np.take(part, pairs[2 * t:2 * t + n], axis=0)
        pooled.append(out.max(axis=0) + bias)
    return _softmax(np.maximum(np.concatenate(pooled, axis=1), 0) @ net.dense + net.offset)


def classify(net: Network, tables: list[list[np.ndarray]], texts: list[str]) -> np.ndarray:
    """(texts, languages) probabilities of whole texts; an empty text is one window of padding."""
    raw = [t.encode("utf-8", "surrogatepass").lower() for t in texts]
    n_windows = np.array([max(1, -(-(len(b) - (WINDOW - STRIDE)) // STRIDE)) for b in raw])
    room = n_windows * STRIDE + WINDOW - STRIDE
    begins = np.cumsum(room) - room
    held = np.zeros(int(room.sum()), dtype=np.uint8)
    for at, b in zip(begins, raw):
        held[at:at + len(b)] = np.frombuffer(b, dtype=np.uint8)
    owner = np.repeat(np.arange(len(raw)), n_windows)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows)
    starts = begins[owner] + within * STRIDE
    weight = np.clip(np.array([len(b) for b in raw])[owner] - within * STRIDE, 1, WINDOW).astype(np.float64)
    total = np.zeros((len(raw), len(net.languages)))
    step = np.arange(WINDOW)[:, None]
    for k in range(0, len(starts), _AT_ONCE):
        part = slice(k, k + _AT_ONCE)
        np.add.at(total, owner[part], window_probabilities(net, tables, held[starts[part] + step]) * weight[part, None])
    return total / np.maximum(total.sum(axis=1, keepdims=True), 1e-12)


def held_out(id_: Column) -> Column:
    """Whether a document is kept from training: remainder 1 of CRC-32 of the id's digits by 3. Not for null ids."""
    return F.coalesce(F.crc32(id_.cast("string")) % 3 == 1, F.lit(False))


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def train_on(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Network | None:
    """Network learnt from at most ``sample`` documents of each language: those with the smallest hashes of their ids,
    a slice of each from a place that the hash names. Documents held out, without an id, label or letter take no part."""
    id_, text, lang = F.col(f"`{id_col}`"), F.col(f"`{text_col}`"), F.col(f"`{lang_col}`")
    use = docs.filter(id_.isNotNull() & lang.isNotNull() & ~held_out(id_) & has_letter(text))
    hashed = F.xxhash64(id_)
    # a share of each language that holds about twice the sample, so that only so many rows are ranked, whatever the input
    sizes = use.groupBy(lang.alias("lang")).agg(F.count("*").alias("n")).collect()
    share = F.lit(False)
    for r in sizes:
        part = min(1.0, (2 * sample + 200) / r["n"])
        share = F.when(lang == F.lit(r["lang"]), F.pmod(hashed, F.lit(1 << 40)) < int(part * (1 << 40)) + 1).otherwise(share)
    at = (F.pmod(F.xxhash64(F.lit(1), id_), F.greatest(F.length(text) - SLICE_CHARS, F.lit(0)) + 1) + 1).cast("int")
    rows = use.filter(share).select(lang.alias("lang"), F.pmod(hashed, F.lit(1 << 40)).alias("h"), text.substr(at, F.lit(SLICE_CHARS)).alias("slice"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h", "slice"))
    taken = rows.withColumn("place", place).filter(F.col("place") <= sample).select("lang", "h", "slice").collect()  # of bounded size
    taken.sort(key=lambda r: (r["h"], r["lang"], r["slice"]))
    taken = [r for r in taken if r["slice"]]
    return train([r["slice"].encode("utf-8", "surrogatepass").lower() for r in taken], [r["lang"] for r in taken])


def languages_of(docs: DataFrame, net: Network | None, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score (existing columns of these names are replaced).

    lang_pred is ``und`` and score 0 for a null text, one without a letter, and with no network; otherwise score is the
    document's probability of lang_pred; of equal ones the first language in alphabetical order."""
    kept = [c for c in docs.columns if c == text_col or c.lower() not in ("lang_pred", "score")]
    text = F.col(f"`{text_col}`")
    if net is None:
        return docs.select(*[f"`{c}`" for c in kept]).withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0)})

    @F.pandas_udf("lang string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        found = classify(net, held(("network", net.key), lambda: _tables(net)), texts.tolist())
        best = found.argmax(axis=1)
        give_back()
        return pd.DataFrame({"lang": [net.languages[b] for b in best], "score": np.minimum(found[np.arange(len(best)), best], 1.0)})

    name = free_name("_found", kept)
    known = has_letter(text)
    return (docs.withColumn(name, predict(F.coalesce(text.cast("string"), F.lit("")))).select(
        *[f"`{c}`" for c in kept], F.when(known, F.col(f"{name}.lang")).otherwise(UNKNOWN).alias("lang_pred"),
        F.when(known, F.col(f"{name}.score")).otherwise(0.0).alias("score")))


def accepted(docs: DataFrame, net: Network | None, text_col: str = "text", languages: tuple[str, ...] | None = None,
             above_chance: float = ABOVE_CHANCE) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose language is known (not ``und``), among ``languages`` if given,
    and predicted with a probability that is ``above_chance`` of the way from an even one (1 / number of languages) to 1.

    Null texts and texts without a letter go, and all rows if no network could be trained. Texts of any length are read
    in windows; rows are judged one by one, so repeated ones alike; an empty table gives none."""
    even = 1 / len(net.languages) if net is not None else 1.0
    min_score = even + above_chance * (1 - even) - 1e-6  # a single language has a probability of 1
    rows = docs.select(F.struct(*[f"`{c}`" for c in docs.columns]).alias("row"), F.col(f"`{text_col}`").alias("text"))
    found = languages_of(rows, net, "text").filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= min_score))
    if languages is not None:
        found = found.filter(F.col("lang_pred").isin(*languages))
    return found.select("row.*")
