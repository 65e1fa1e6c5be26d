"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text recognises every substring of that text. A document is parsed
greedily into the longest phrases that the automaton recognises; the language that needs the fewest phrases for the
same characters wins. Letters are compared in lower case; a run of other characters counts as one space. The most
frequent letters of the sample are symbols of their own; every other letter of it is spelled with four symbols out of
sixteen, so no letter loses its identity however many scripts there are. Letters that no sample has are one symbol.

Automata are dense transition tables (a missing transition restarts at the root and counts a phrase), so a batch of
texts is parsed by NumPy gathers over many lanes at once. A lane is SEGMENT characters of one text; phrases end there,
alike for all languages. Whole texts are parsed.

Learning is bounded: at most DOCS documents of each language, CHARS characters of each language (WINDOWS windows spread
over each whole text) and TOTAL characters of all languages (all parameters); documents are chosen by hash, and of more
than LANGS languages the most frequent ones are learnt. So the model has at most 2 * TOTAL states (150 MB) whatever the
input. No shuffle of texts.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm.common import small_batches

DOCS, CHARS, TOTAL, LANGS, WINDOWS = 100, 30_000, 300_000, 500, 4
LETTERS, DIGITS, SEGMENT, CHUNK = 46, 16, 512, 2_000_000
SPACE, OTHER, SPELLED = 0, 1, 256
UNKNOWN = "und"
#: Texts of fewer symbols are not judged by their rate. A text is foreign beyond FOREIGN times the usual rate.
LEAST, FOREIGN = 400, 2.0


def automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of a sequence (Blumer et al. 1985); state 0 is the root."""
    step, link, length, last = [{}], [-1], [0], 0
    for c in codes:
        new = len(step)
        step.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(step)
                step.append(dict(step[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return step


def encode(text: str, table: np.ndarray) -> np.ndarray:
    """Symbols of the text's characters, with runs of non-letters as one SPACE and rare letters spelled out."""
    codes = table[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")]
    keep = codes != SPACE
    keep[1:] |= codes[:-1] != SPACE
    codes = codes[keep]
    if len(codes) and codes.max() >= SPELLED:
        long = codes >= SPELLED
        codes = np.repeat(codes, np.where(long, 4, 1))
        spelled = codes >= SPELLED
        digits = codes[spelled].reshape(-1, 4) - SPELLED
        codes[spelled] = (2 + LETTERS + (digits >> np.array([12, 8, 4, 0], np.uint32)) % DIGITS).ravel()
    return codes.astype(np.uint8)


class Model:
    """Tables of all languages in one array; entry: next state's offset, or its complement if a new phrase begins."""

    def __init__(self, samples: dict[str, list[str]], letters: int = LETTERS, chars: int = CHARS):
        self.langs = sorted(samples)
        texts = {lang: " ".join(samples[lang]).lower()[:chars] for lang in self.langs}
        known = Counter(c for t in texts.values() for c in t if c.isalpha())
        ranked = [c for c, _ in sorted(known.items(), key=lambda x: (-x[1], x[0]))]
        self.letters, self.rare = ranked[:letters], ranked[letters : letters + DIGITS**4]
        self.width = letters + DIGITS + 2
        table = self.table()
        codes = {lang: encode(texts[lang], table) for lang in self.langs}
        # One table from the start, of two states a symbol at most: the driver never holds a second copy, and what isn't written to takes no memory.
        self.next = np.empty(sum(2 * len(c) + 2 for c in codes.values()) * self.width, dtype=np.int32)
        self.roots, base = [], 0
        for lang in self.langs:
            step = automaton(codes.pop(lang).tolist())
            # One state more stands for a phrase of one character that the sample never has.
            dense = self.next[base : base + (len(step) + 1) * self.width].reshape(-1, self.width)
            first = np.full(self.width, base + len(step) * self.width, dtype=np.int32)
            for c, q in step[0].items():
                first[c] = base + q * self.width
            dense[:] = ~first
            for state, to in enumerate(step):
                for c, q in to.items():
                    dense[state, c] = base + q * self.width
            dense[0] = first
            self.roots.append(base)
            base += dense.size
        self.next = self.next[:base]
        self.usual = 0.0

    def __getstate__(self) -> dict:
        """Tables are sent compressed, to a few hundredths of their size."""
        return self.__dict__ | {"next": zlib.compress(self.next, 1)}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ = state | {"next": np.frombuffer(zlib.decompress(state["next"]), dtype=np.int32)}

    def table(self) -> np.ndarray:
        """Of each code point the symbol, or SPELLED and more for letters that are spelled out."""
        table = np.fromiter(map(str.isalpha, map(chr, range(0x110000))), dtype=np.uint32, count=0x110000) * np.uint32(OTHER)
        for i, c in enumerate(self.letters):
            table[ord(c)] = 2 + i
        for i, c in enumerate(self.rare):
            table[ord(c)] = SPELLED + i
        return table

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """(texts, languages) numbers of phrases."""
        lengths = np.array([len(t) for t in texts], dtype=np.int64)
        lanes = -(-lengths // SEGMENT)
        owner = np.repeat(np.arange(len(texts)), lanes)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        start = np.repeat(np.cumsum(lengths) - lengths, lanes) + nth * SEGMENT
        length = np.minimum(SEGMENT, lengths[owner] - nth * SEGMENT)
        order = np.argsort(-length, kind="stable")
        owner, start, length = owner[order], start[order], length[order]
        codes = np.concatenate(texts)
        state = np.repeat(np.array(self.roots, dtype=np.int32)[:, None], len(owner), axis=1)
        count = np.ones(state.shape, dtype=np.int32)
        active = np.searchsorted(-length, -np.arange(SEGMENT), side="left")  # lanes longer than t
        for t in range(int(length[0]) if len(length) else 0):
            m = active[t]
            to = self.next[state[:, :m] + codes[start[:m] + t]]
            new = to >> 31
            count[:, :m] -= new
            state[:, :m] = to ^ new
        return np.stack([np.bincount(owner, weights=c, minlength=len(texts)) for c in count], axis=1)

    def predict(self, texts: list[str | None], table: np.ndarray) -> tuple[list[str], list[float], list[float]]:
        """Of each text the language, the score and the phrases a symbol that it needs."""
        names, scores, rates = [UNKNOWN] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
        group, size = [], 0
        for i, text in enumerate(texts):
            codes = encode(text, table) if text else np.zeros(0, np.uint8)
            if self.langs and (codes != SPACE).any():
                group.append((i, codes))
                size += len(codes)
            if group and (size >= CHUNK or i == len(texts) - 1):
                self._decide(group, names, scores, rates)
                group, size = [], 0
        if group:
            self._decide(group, names, scores, rates)
        return names, scores, rates

    def _decide(self, group, names, scores, rates) -> None:
        counts = self.phrases([c for _, c in group])
        best = counts.argmin(axis=1)
        two = np.sort(counts, axis=1)[:, :2]
        for row, (i, codes) in enumerate(group):
            names[i] = self.langs[best[row]]
            rates[i] = float(two[row, 0] / len(codes)) if len(codes) >= LEAST else 0.0
            scores[i] = 1.0 if len(self.langs) == 1 else float(1 - two[row, 0] / two[row, 1])


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = DOCS, chars: int = CHARS, total: int = TOTAL, langs: int = LANGS) -> Model:
    """The model of a bounded sample: of each language the per_lang smallest hashes among documents not held out.

    As many documents more of each language, taken together, tell the usual number of phrases a symbol: model.usual is
    that of the language which needs most of them, 0 where there are too few documents.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    labelled = rows.where(f"lang IS NOT NULL AND {HELD_OUT} = 0")
    often = labelled.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(langs).select("lang")
    first = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = labelled.join(F.broadcast(often), "lang").select("doc_id", "lang").withColumn("n", F.row_number().over(first)).where(F.col("n") <= 2 * per_lang).collect()
    known = Counter(r.lang for r in ids if r.n <= per_lang)
    own = min(chars, total // max(1, len(known)))
    # A window of a text that has several; the windows of a text are as many characters as its share.
    w = max(1, own // max([min(per_lang, *known.values()) if known else 1, 1]) // WINDOWS - 1)
    spread = F.expr(f"IF(char_length(text) <= {WINDOWS * w}, text, array_join(transform(sequence(0, {WINDOWS - 1}), i -> substring(text, CAST(1 + i * (char_length(text) - {w}) / {WINDOWS - 1} AS INT), {w})), ' '))")
    # A join, since the driver's memory grows with a plan of as many literals.
    chosen = docs.sparkSession.createDataFrame([(r.doc_id,) for r in ids], T.StructType([labelled.schema["doc_id"]]))
    found = labelled.join(F.broadcast(chosen), "doc_id", "left_semi").groupBy("lang", "doc_id").agg(F.min(spread).alias("part")).collect()
    parts = {(r.lang, r.doc_id): r.part for r in found if r.part}
    samples: dict[str, list[str]] = {}
    rest: dict[str, list[str]] = {}
    for r in sorted(ids, key=lambda r: (r.lang, r.n)):
        if part := parts.pop((r.lang, r.doc_id), None):
            (samples if r.n <= per_lang else rest).setdefault(r.lang, []).append(part)
    model = Model(samples, chars=own)
    if samples and rest:
        model.usual = max(model.predict([" ".join(x) for x in rest.values()], model.table())[2])
    return model


#: 1 for documents that are held out from learning; a null id is never learnt from.
HELD_OUT = "CAST(coalesce(crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 3 = 1, true) AS INT)"


def predicted(docs: DataFrame, model: Model, text_col: str = "text", into: str = "lang_found") -> DataFrame:
    """docs with a struct column (lang_pred, score, rate): rate is the phrases a symbol, 0 for texts of under LEAST symbols."""
    small_batches(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, rate double")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        table = m.table()
        for batch in texts:
            names, scores, rates = m.predict(list(batch), table)
            yield pd.DataFrame({"lang_pred": names, "score": scores, "rate": rates})

    return docs.withColumn(into, of(F.col(text_col)))


def in_known_language(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs whose text is in a language that was learnt from docs.

    Rejected are texts without a letter and texts of at least LEAST symbols that need more than FOREIGN times the usual
    phrases in every language (noise, unknown languages). Where nothing is labelled, only texts without a letter go.
    """
    model = learn(docs, text_col=text_col)
    if not model.langs:
        return docs.where(F.col(text_col).rlike(r"\p{L}"))
    packed = docs.select(F.struct(*docs.columns).alias("row"), F.col(text_col).alias("text"))
    found = predicted(packed, model, into="found").where(F.col("found.lang_pred") != UNKNOWN)
    return (found.where(F.col("found.rate") <= FOREIGN * model.usual) if model.usual else found).select("row.*")


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score): a row for each row of docs.

    `und` with score 0 where the text is null, empty or has no letter, or where nothing is labelled. The score is the
    share of phrases that the best language saves against the second one; equal counts give the first language by name.
    """
    model = learn(docs, id_col, text_col, lang_col)
    out = predicted(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), model)
    return out.selectExpr("doc_id", f"doc_id IS NOT NULL AND {HELD_OUT} = 1 AS held_out", "lang_found.lang_pred AS lang_pred", "lang_found.score AS score")


def op5_language_id(spark, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
