"""Language identification by unigrams over a public vocabulary's pieces, summed over all segmentations of each word."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batches, fold, released, remembered, stored

VOCABULARY = "piece_bpe_32k.model"
#: Labelled documents a language is learned from, about: those with the smallest hashes.
SAMPLE = 1_500
ROUNDS = 4
#: A character that is no piece of its own has this probability in every language.
UNKNOWN = 1e-7
#: Letters of a run up to which words of one length are scored together; a longer one is scored by itself, with sums scaled at
#: each letter.
RUN = 32
REMEMBERED = 300_000
WORD = re.compile(r"[^\W\d_]+")
BASE = np.uint64(0x9E3779B97F4A7C15)


class Vocabulary:
    """Pieces of letters, with an optional word start, as sorted 64-bit codes."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = sorted({p for p in map(model.id_to_piece, range(model.get_piece_size())) if p == p.lower() and p.replace("▁", "", 1).isalpha()})
        self.length = max(map(len, pieces))
        codes = np.array([self.code(p) for p in pieces], np.uint64)
        order = np.argsort(codes)
        self.codes, self.sizes = codes[order], np.array([len(p) for p in pieces])[order]

    @staticmethod
    def code(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(BASE) + ord(c) + 1) & (1 << 64) - 1
        return h

    def find(self, codes: np.ndarray) -> np.ndarray:
        """Piece numbers, -1 for none."""
        at = np.searchsorted(self.codes, codes)
        at[at == len(self.codes)] = 0
        return np.where(self.codes[at] == codes, at, -1)


def vocabulary(path: str | None) -> Vocabulary:
    import public_tokenizers

    path = path or public_tokenizers.path(VOCABULARY)
    return remembered(f"vocabulary {path}", lambda: Vocabulary(path))


def lattice(words: list[str], vocab: Vocabulary):
    """For words of one length: the piece numbers of their substrings, as (start, length) -> array; start marks included."""
    n = len(words[0]) + 1
    chars = np.empty((len(words), n), np.uint64)
    chars[:, 0] = ord("▁") + 1
    chars[:, 1:] = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), n - 1).astype(np.uint64) + np.uint64(1)
    head = np.zeros((len(words), n + 1), np.uint64)
    for i in range(n):
        head[:, i + 1] = head[:, i] * BASE + chars[:, i]
    power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, BASE)]))
    found = {}
    for size in range(1, min(vocab.length, n) + 1):
        for i in range(n - size + 1):
            if i == 0 and size == 1:
                continue  # the mark alone is no piece of a word
            found[i, size] = vocab.find(head[:, i + size] - head[:, i] * power[size])
    return n, found


def _weights(ids: np.ndarray, probs: np.ndarray, single: bool) -> np.ndarray:
    """Probabilities of the pieces, one row more at the end for none; a lone unknown character keeps a floor."""
    p = probs[ids]
    if single:
        np.maximum(p, UNKNOWN, out=p)
    return p


def forward(words: list[str], vocab: Vocabulary, probs: np.ndarray, lattices=None) -> np.ndarray:
    """Natural logarithm of each word's probability in each language: the sum over all its segmentations.

    ``probs`` has a last row of zeros, which piece number -1 takes.
    """
    out = np.empty((len(words), probs.shape[1]))
    for i, w in enumerate(words):
        if len(w) > RUN:
            out[i] = long_word(w, vocab, probs)
    for rows in _by_length(words).values():
        for lo in range(0, len(rows), 50_000):
            part = rows[lo:lo + 50_000]
            n, found = lattice([words[i] for i in part], vocab)
            alpha = _alpha(n, found, probs, len(part))
            out[part] = np.log(alpha[n])
    return out


def _by_length(words: list[str]) -> dict[int, list[int]]:
    """Places of the words that are scored together, by their length."""
    by: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        if len(w) <= RUN:
            by.setdefault(len(w), []).append(i)
    return by


def long_word(word: str, vocab: Vocabulary, probs: np.ndarray, uses: bool = False):
    """The logarithm of one word's probability in each language and, if wanted, its pieces with their expected uses.

    Sums over segmentations of each beginning are kept as a number near one and the logarithm of its scale, so a run of
    any length stays in range.  Work grows with letters times the longest piece.
    """
    chars = np.frombuffer(("▁" + word).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    n, size = len(chars), min(vocab.length, len(chars))
    head = [0]
    for c in chars.tolist():
        head.append((head[-1] * int(BASE) + c) & (1 << 64) - 1)
    head = np.array(head, np.uint64)
    power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, BASE)]))
    ids = np.full((n + 1, size), -1)  # by the place where a piece ends, and its length less one
    for s in range(1, size + 1):
        ids[s:, s - 1] = vocab.find(head[s:] - head[:-s] * power[s])
    ids[1, 0] = -1  # the mark alone is no piece of a word
    langs = probs.shape[1]

    def weights(end: int, many: int) -> np.ndarray:
        p = probs[ids[end, :many]]
        np.maximum(p[0], UNKNOWN, out=p[0])
        return p

    def sums(way: Iterator[tuple[int, np.ndarray, np.ndarray]], first: int) -> tuple[np.ndarray, np.ndarray]:
        value, scale = np.zeros((n + 1, langs)), np.full((n + 1, langs), -np.inf)
        value[first], scale[first] = 1.0, 0.0
        for at, others, p in way:
            top = scale[others].max(0)
            total = (value[others] * p * np.exp(scale[others] - top)).sum(0)
            value[at], scale[at] = 1.0, top + np.log(total)
        return value, scale

    ahead = ((end, end - 1 - np.arange(min(end, size)), weights(end, min(end, size))) for end in range(1, n + 1))
    _, alpha = sums(ahead, 0)
    if not uses:
        return alpha[n]

    def back(start: int) -> tuple[int, np.ndarray, np.ndarray]:
        ends = start + 1 + np.arange(min(size, n - start))
        p = probs[ids[ends, np.arange(len(ends))]]
        np.maximum(p[0], UNKNOWN, out=p[0])
        return start, ends, p

    _, beta = sums(map(back, range(n - 1, -1, -1)), n)
    end, s = np.nonzero(ids >= 0)
    p = probs[ids[end, s]]
    p[s == 0] = np.maximum(p[s == 0], UNKNOWN)
    with np.errstate(divide="ignore"):
        return alpha[n], ids[end, s], np.exp(alpha[end - s - 1] + np.log(p) + beta[end] - alpha[n])


def _alpha(n: int, found, probs: np.ndarray, count: int) -> list[np.ndarray]:
    alpha = [np.ones((count, probs.shape[1]))] + [np.zeros((count, probs.shape[1])) for _ in range(n)]
    for end in range(1, n + 1):
        for size in range(1, end + 1):
            ids = found.get((end - size, size))
            if ids is None:
                if size == 1 and end == 1:  # the mark by itself, before an unknown start
                    alpha[1] += UNKNOWN
                continue
            hit = ids >= 0
            if size > 1 and not hit.any():
                continue
            alpha[end] += alpha[end - size] * _weights(ids, probs, size == 1)
    return alpha


def expected(words: list[str], counts: np.ndarray, vocab: Vocabulary, probs: np.ndarray) -> np.ndarray:
    """Expected uses of each piece in each language, over all segmentations of the counted words (forward and backward)."""
    total = np.zeros_like(probs)
    for i, w in enumerate(words):
        if len(w) > RUN:
            _, ids, use = long_word(w, vocab, probs, True)
            for k in range(probs.shape[1]):
                total[:, k] += np.bincount(ids, use[:, k] * counts[i, k], len(total))
    for rows in _by_length(words).values():
        for lo in range(0, len(rows), 20_000):
            part = rows[lo:lo + 20_000]
            n, found = lattice([words[i] for i in part], vocab)
            alpha = _alpha(n, found, probs, len(part))
            beta = [np.zeros_like(alpha[0]) for _ in range(n)] + [counts[part] / alpha[n]]
            for start in range(n - 1, -1, -1):
                for size in range(1, n - start + 1):
                    ids = found.get((start, size))
                    if ids is None:
                        continue
                    p = _weights(ids, probs, size == 1)
                    use = alpha[start] * p * beta[start + size]
                    hit = ids >= 0
                    for k in range(probs.shape[1]):
                        total[:, k] += np.bincount(ids[hit], use[hit, k], len(total))
                    beta[start] += p * beta[start + size]
    return total


def runs(text: str | None) -> list[str]:
    """Lower-case runs of letters, whole; none if the text has no letter."""
    found = WORD.findall(text.lower()) if text else []
    if found and not any(any(map(str.isalpha, w)) for w in found):
        return []
    return found


def learn(docs: DataFrame, lang: str, text: str, key: str, keep, sample: int = SAMPLE, path: str | None = None) -> tuple[list[str], np.ndarray]:
    """(languages in order, piece probabilities with a last row of zeros), by expectation maximisation.

    Each language is learned from about ``sample`` labelled documents (those whose hash is below its share), in their
    whole length.  Their word counts stay a table; each round adds up expected piece counts where the words are, and
    only vocabulary x languages numbers reach the driver.
    """
    vocab = vocabulary(path)
    rows = docs.where(F.col(lang).isNotNull() & keep).select(F.col(lang).cast("string").alias("_lang"), F.col(key).alias("_id"), F.col(text).cast("string").alias("_text"))
    sizes = {r["_lang"]: r["count"] for r in rows.groupBy("_lang").count().collect()}  # one row a language
    langs = sorted(sizes)
    size = len(vocab.codes)
    if not langs:
        return [], np.zeros((size + 1, 0))
    shares = F.create_map(*[F.lit(x) for name in langs for x in (name, min(1.0, sample / sizes[name]))])
    draw = F.pmod(F.xxhash64("_id", F.lit(17)), F.lit(1 << 30)) / float(1 << 30)
    chosen = rows.where(draw < F.element_at(shares, F.col("_lang"))).select("_lang", "_text")
    number = {name: i for i, name in enumerate(langs)}

    def split(cols) -> Iterator[pa.RecordBatch]:
        tally: dict[tuple[int, str], int] = {}
        for name, t in zip(cols["_lang"].to_pylist(), cols["_text"]):
            for w in runs(t.as_py()):
                tally[number[name], w] = tally.get((number[name], w), 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in tally], pa.int32()), pa.array([w for _, w in tally], pa.string()), pa.array(list(tally.values()), pa.int64())], ["k", "w", "c"])

    counted = stored(batches(chosen, split, "k int, w string, c bigint").groupBy("w", "k").agg(F.sum("c").alias("c")).groupBy("w").agg(F.map_from_entries(F.collect_list(F.struct("k", "c"))).alias("c")))
    probs = np.vstack([np.full((size, len(langs)), 1.0 / size), np.zeros((1, len(langs)))])
    for _ in range(ROUNDS):
        now = docs.sparkSession.sparkContext.broadcast(probs)  # vocabulary x languages

        def step(cols) -> Iterator[pa.RecordBatch]:
            words = cols["w"].to_pylist()
            counts = np.zeros((len(words), len(langs)))
            for i, c in enumerate(cols["c"].to_pylist()):
                for k, v in c:
                    counts[i, k] = v
            use = expected(words, counts, vocabulary(path), now.value)
            at, k = np.nonzero(use)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(k, pa.int32()), pa.array(use[at, k], pa.float64())], ["p", "k", "u"])

        # Rounded to steady the sum against the order of its parts.
        got = batches(counted, step, "p int, k int, u double").groupBy("p", "k").agg(F.sum(F.round(F.col("u") * 1e6).cast("decimal(30,0)")).cast("double").alias("u")).toArrow()
        use = np.zeros_like(probs)
        use[got["p"].to_numpy(), got["k"].to_numpy()] = got["u"].to_numpy() / 1e6
        use[:-1] += 0.05
        probs = use / use.sum(0)
        probs[-1] = 0.0
    released(counted)
    return langs, probs


def predict(docs: DataFrame, langs: list[str], probs: np.ndarray, text: str = "text", path: str | None = None, columns: tuple[str, ...] = ("lang_pred", "score")) -> DataFrame:
    """Add the likeliest language of each whole text and its posterior probability under equal priors."""
    names = docs.columns
    model = docs.sparkSession.sparkContext.broadcast(np.ascontiguousarray(probs))
    at = names.index(text)
    schema = T.StructType([*docs.schema.fields, T.StructField(columns[0], T.StringType()), T.StructField(columns[1], T.DoubleType())])

    def tag(cols) -> Iterator[pa.RecordBatch]:
        vocab, known = vocabulary(path), remembered("words", dict, hash(model.value.tobytes()))
        arrays = list(cols.values())
        texts, found, lo, held = arrays[at], [], 0, 0
        for i in range(len(texts)):  # a few MB of text at a time
            found.append(runs(texts[i].as_py()) if texts[i].is_valid else [])
            held += sum(map(len, found[-1])) if found[-1] else 0
            if held > 2 << 20 or i + 1 == len(texts):
                fresh = list({w for words in found for w in words if w not in known})
                extra = _Both(known)
                if fresh:
                    logs = list(map(bytes, forward(fresh, vocab, model.value).astype(np.float32)))
                    short = len(known) + len(fresh) < REMEMBERED
                    known.update((w, x) for w, x in zip(fresh, logs) if short and len(w) <= RUN)
                    extra.update((w, x) for w, x in zip(fresh, logs) if not short or len(w) > RUN)
                best, sure = [], []
                for words in found:
                    if not words or not langs:
                        best.append("und")
                        sure.append(0.0)
                        continue
                    total = np.frombuffer(b"".join(map(extra.__getitem__, words)), np.float32).reshape(-1, len(langs)).sum(0, dtype=np.float64)
                    k = int(total.argmax())
                    best.append(langs[k])
                    sure.append(float(1 / np.exp(np.clip(total - total[k], -700, 0)).sum()))
                yield pa.RecordBatch.from_arrays([*[a.slice(lo, len(found)) for a in arrays], pa.array(best, pa.string()), pa.array(sure, pa.float64())], schema.names)
                lo, held, found = i + 1, 0, []

    return batches(docs, tag, schema)


class _Both(dict):
    """New words, with those remembered behind them."""

    def __init__(self, behind: dict):
        super().__init__()
        self.behind = behind

    def __missing__(self, word: str) -> bytes:
        return self.behind[word]


def identify(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", folds: int = 3, out_fold: int = 1, sample: int = SAMPLE, path: str | None = None) -> DataFrame:
    """key, ``held_out``, ``lang_pred`` and ``score`` of every row, learned from rows outside fold ``out_fold``.

    Runs of letters are scored whole, however long.  A text that is null or has no letter is ``und`` with score 0, as is
    every text if nothing is labelled.  Null keys
    are in fold 0.  Repeated rows get equal results; an empty table gives none; other columns are not read.
    """
    langs, probs = learn(docs, lang, text, key, fold(F.col(key), folds) != out_fold, sample, path)
    df = docs.select(F.col(key).alias("_id"), F.col(text).cast("string").alias("_text"))
    return predict(df, langs, probs, "_text", path).select(F.col("_id").alias(key), (fold(F.col("_id"), folds) == out_fold).alias("held_out"), "lang_pred", "score")
