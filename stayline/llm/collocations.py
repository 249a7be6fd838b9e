"""Phrase collocations by dynamic itemset counting.

The corpus is stored once as rows of word numbers (64-bit hashes of language and word, 0 between pieces),
dealt to `shards` shards, and the shards are scanned in a cycle. All words are counted from the first scan
on. A phrase is activated as soon as both its subphrases (without its last and without its first word)
have reached the threshold in what was counted so far; from then on it is counted in each scan, whatever
its length, until it has seen every shard once. Its count is then whole, and it leaves the scans.

Which phrases have reached the threshold is told to the scans by a stamp filter: 2^`filter_bits` bytes, in
which a phrase has two slots, each with the number of the scan after which it was first set. Stamps never
change, so a phrase's activation (one scan after the latest stamp of all its parts) is the same in every
scan and it is counted in exactly `shards` consecutive scans. Slots that unrelated phrases share only activate a
phrase early, which costs work and never exactness. The filter is what is broadcast, and its size is fixed;
counts stay in tables, and sums pass through shuffles of per-task counts.

Words are told apart by 64-bit hashes, phrases by the hashes of all their words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stayline.llm.common import drop_folder, kept, shared_folder

#: Between pieces: these bytes end one. Words are runs of anything else but space and tab.
BREAKS = b".,;:!?\n\x0b\x0c\r"
UNSET = 255
_TABLE = bytes.maketrans(BREAKS + b"\t", b"\n" * len(BREAKS) + b" ")
_CUT = re.compile(rb"[ \n]")
#: Bytes of text turned into words at a time, words of one stored row, and words counted at a time.
_SLICE, _ROW, _BLOCK = 1 << 22, 1 << 20, 1 << 21
_MOST_KNOWN, _MOST_MET = 1_000_000, 100_000
#: The shard of the words' spellings, which no scan reads.
SPELLED = -1
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
COUNTS = "phrase binary, n long, began int"


def token_slices(text: str | None) -> Iterator[list[bytes]]:
    """A text's lower-cased words in order, `\\n` between pieces, a slice of the text at a time; empty
    strings among them mean nothing."""
    raw = (text or "").encode().lower().translate(_TABLE)
    at = 0
    while at < len(raw):
        end = _CUT.search(raw, at + _SLICE - 1)
        upto = end.end() if end else len(raw)
        yield raw[at:upto].replace(b"\n", b" \n ").split(b" ")
        at = upto


class WordNumbers(dict):
    """64-bit numbers of the words of a language; 0 is the break. A bounded table keeps those met before."""

    SKIP = 1  # the number of an empty string; no word has it

    def __init__(self, lang: str, met: list[tuple[int, bytes]] | None = None):
        super().__init__()
        self.head, self.met = lang.encode() + b"\0", met

    def __missing__(self, word: bytes) -> int:
        if word == b"\n":
            number = 0
        elif not word:
            number = self.SKIP
        else:
            number = max(xxhash.xxh3_64_intdigest(self.head + word), self.SKIP + 1)
            if self.met is not None:
                self.met.append((number, word))
        self[word] = number
        return number

    def numbers(self, words: list[bytes]) -> np.ndarray:
        if len(self) > _MOST_KNOWN:
            self.clear()
        found = np.fromiter(map(self.__getitem__, words), np.uint64, len(words))
        return found[found != self.SKIP]


def mixed(phrase: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of phrases with one more word each."""
    x = (phrase * _A) ^ (word + _B)
    x ^= x >> np.uint64(32)
    x *= _B
    x ^= x >> np.uint64(29)
    x *= _A
    return x ^ (x >> np.uint64(32))


def slots(marks: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64((1 << bits) - 1)
    return (marks & mask).astype(np.int64), ((marks >> np.uint64(64 - bits)) & mask).astype(np.int64)


def stamped(filter_: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """The scan after which both slots of each hash were set; UNSET if one is not."""
    one, two = slots(marks, int(len(filter_)).bit_length() - 1)
    return np.maximum(filter_[one], filter_[two])


def open_counts(
    words: np.ndarray, starts: np.ndarray, filter_: np.ndarray, scan: int, shards: int, longest: int,
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Phrases that are active in this scan: arrays of their words (a row each), counts, and the scan in
    which they began. `starts` marks the positions that belong to this shard."""
    real = words != 0
    if scan < shards:
        own, n = np.unique(words[real & starts], return_counts=True)
        yield own[:, None], n, np.zeros(len(own), np.int32)
    stamps = np.where(real, stamped(filter_, words), np.uint8(UNSET))
    both = np.maximum(stamps[:-1], stamps[1:])
    at = np.flatnonzero(both != UNSET)  # starts of phrases whose two subphrases have reached the threshold
    both, marks = both[at], words[at]
    for size in range(2, longest + 1):
        if not len(at):
            return
        longer = mixed(marks, words[at + size - 1])
        began = both.astype(np.int32) + 1
        active = (began > scan - shards) & (began <= scan) & starts[at]
        if active.any():
            found, first, n = np.unique(longer[active], return_index=True, return_counts=True)
            where = at[active][first]
            yield words[where[:, None] + np.arange(size)], n, began[active][first]
        if size < longest:
            # Not before its subphrases, whatever other phrases have set its slots.
            stamps = np.maximum(stamped(filter_, longer), both)
            next_ = np.flatnonzero((at[1:] == at[:-1] + 1) & (stamps[:-1] != UNSET) & (stamps[1:] != UNSET))
            marks, both, at = longer[next_], np.maximum(stamps[next_], stamps[next_ + 1]), at[next_]


def _binary(rows: np.ndarray) -> pa.Array:
    """Rows of 64-bit numbers as one binary value each."""
    width = 8 * rows.shape[1]
    flat = np.ascontiguousarray(rows.astype("<u8"))
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(rows), [None, pa.py_buffer(flat)]).cast(pa.binary())


def _word_rows(
    batches: Iterator[pa.RecordBatch], shards: int, longest: int,
    met: dict[str, list[tuple[int, bytes]]] | None = None,
) -> Iterator[pa.RecordBatch]:
    """Rows (lang, text) to rows (shard, lang, size, owned, words): whole texts, long ones in several rows
    that overlap by `longest` - 1 words; phrases are counted where they start. `met` takes words, by
    language, when they are numbered."""
    task, numbers = TaskContext.get(), {}
    made = task.partitionId() if task else 0
    for batch in batches:
        out: list[tuple] = []
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if lang not in numbers:
                if len(numbers) >= 64:
                    numbers.clear()
                numbers[lang] = WordNumbers(lang, None if met is None else met.setdefault(lang, []))
            held = np.zeros(0, np.uint64)
            for tokens in token_slices(text):
                held = np.concatenate([held, numbers[lang].numbers(tokens)])
                while len(held) > _ROW + longest:
                    out.append((made % shards, lang, _ROW, held[:_ROW + longest - 1]))
                    held, made = held[_ROW:], made + 1
            if held.any():
                out.append((made % shards, lang, len(held), held))
                made += 1
        for first in range(0, len(out), 256):
            part = out[first:first + 256]
            yield pa.RecordBatch.from_arrays([
                pa.array([r[0] for r in part], pa.int32()), pa.array([r[1] for r in part], pa.string()),
                pa.array([int(np.count_nonzero(r[3][:r[2]])) for r in part], pa.int64()),
                pa.array([r[2] for r in part], pa.int64()), pa.array([r[3].tobytes() for r in part], pa.binary()),
            ], names=["shard", "lang", "size", "owned", "words"])


def _stored_rows(batches: Iterator[pa.RecordBatch], shards: int, longest: int) -> Iterator[pa.RecordBatch]:
    """As `_word_rows`, and in shard `SPELLED` the words that the task has numbered: `owned` of them, in `words`
    their numbers and then their spellings with spaces between."""
    met: dict[str, list[tuple[int, bytes]]] = {}

    def spelled() -> pa.RecordBatch:
        found = [(lang, list(zip(*words, strict=True))) for lang, words in met.items() if words]
        for words in met.values():
            words.clear()
        raw = [np.array(n, "<u8").tobytes() + b" ".join(words) for _, (n, words) in found]
        return pa.RecordBatch.from_arrays([
            pa.array([SPELLED] * len(found), pa.int32()), pa.array([lang for lang, _ in found], pa.string()),
            pa.array([0] * len(found), pa.int64()), pa.array([len(n) for _, (n, _) in found], pa.int64()),
            pa.array(raw, pa.binary())], names=["shard", "lang", "size", "owned", "words"])

    for out in _word_rows(batches, shards, longest, met):
        yield out
        if sum(map(len, met.values())) >= _MOST_MET:
            yield spelled()
    yield spelled()


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows (owned, words) joined to blocks of words, with a break between rows, and their owned positions."""
    words, starts, size = [], [], 0
    for batch in batches:
        for owned, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            own = np.frombuffer(raw, "<u8")
            flag = np.zeros(len(own) + 1, bool)
            flag[:owned] = True
            words += [own, np.zeros(1, np.uint64)]
            starts.append(flag)
            size += len(flag)
            if size >= _BLOCK:
                yield np.concatenate(words), np.concatenate(starts)
                words, starts, size = [], [], 0
    if size:
        yield np.concatenate(words), np.concatenate(starts)


def _scan(words: DataFrame, filter_: np.ndarray, scan: int, shards: int, longest: int) -> tuple[DataFrame, object]:
    shared = words.sparkSession.sparkContext.broadcast(filter_)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, starts in _blocks(batches):
            for phrase, n, began in open_counts(own, starts, shared.value, scan, shards, longest):
                for at in range(0, len(n), 1 << 17):
                    yield pa.RecordBatch.from_arrays([
                        _binary(phrase[at:at + (1 << 17)]), pa.array(n[at:at + (1 << 17)].astype(np.int64)),
                        pa.array(began[at:at + (1 << 17)].astype(np.int32))], names=["phrase", "n", "began"])

    return words.filter(F.col("shard") == scan % shards).select("owned", "words").mapInArrow(run, COUNTS), shared


def _new_slots(reached: DataFrame, bits: int) -> np.ndarray:
    """The slots of phrases, found by the executors; at most 2^bits / 64 rows come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [np.zeros(0, np.int64)]
            for raw in batch.column(0).to_pylist():
                word = np.frombuffer(raw, "<u8")
                mark = word[:1]
                for k in range(1, len(word)):
                    mark = mixed(mark, word[k:k + 1])
                both += slots(mark, bits)
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(both)))], names=["slot"])

    found = reached.select("phrase").mapInArrow(run, "slot long") \
        .groupBy(F.expr("slot div 64").alias("cell")) \
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(slot % 64 as int))")).alias("bits")).toArrow()
    cell, word = found["cell"].to_numpy(), found["bits"].to_numpy().astype("<i8")
    flags = np.unpackbits(word.view(np.uint8), bitorder="little").reshape(-1, 64) if len(cell) else np.zeros((0, 64), bool)
    row, bit = np.nonzero(flags)
    return cell[row] * 64 + bit


def word_table(docs: DataFrame, lang: str, text: str, place: str, longest: int, shards: int) -> DataFrame:
    """The corpus as rows of word numbers, written to `place` by shard, with the words' spellings."""
    schema = "lang string, size long, owned long, words binary, shard int"
    docs.select(lang, text).mapInArrow(
        lambda b: _stored_rows(b, shards, longest), "shard int, lang string, size long, owned long, words binary") \
        .write.option("compression", "zstd").option("parquet.page.size.row.check.min", "4") \
        .option("parquet.block.size.row.check.min", "4").partitionBy("shard").parquet(f"{place}/words")
    return docs.sparkSession.read.schema(schema).parquet(f"{place}/words")


def phrase_counts(
    words: DataFrame, place: str, least: int, longest: int, shards: int, filter_bits: int,
) -> tuple[DataFrame, DataFrame]:
    """From a word table (phrase, n) of every word and phrase with n >= `least`, and (lang, n) of all words. A phrase
    is the little-endian 64-bit numbers of its words."""
    spark = words.sparkSession
    totals = words.filter(F.col("shard") != SPELLED).groupBy("lang").agg(F.sum("size").alias("n"))
    filter_ = np.full(1 << filter_bits, UNSET, np.uint8)
    state, whole, scan, last_set = None, [], 0, 0
    table = "phrase binary, n long, began int, before long, open boolean"
    while scan < shards or scan - last_set <= shards:
        seen, shared = _scan(words, filter_, scan, shards, longest)
        seen = seen.withColumn("before", F.lit(0).cast("long"))
        if state is not None:
            seen = seen.unionByName(state.select("phrase", "n", "began", F.col("n").alias("before")))
        counted = seen.groupBy("phrase").agg(F.sum("n").alias("n"), F.max("began").alias("began"), F.sum("before").alias("before")) \
            .withColumn("open", F.col("began") + shards - 1 > scan).filter(F.col("open") | (F.col("n") >= least))
        path = f"{place}/scan{scan}"
        counted.write.option("compression", "zstd").partitionBy("open").parquet(path)
        shared.destroy()
        if state is not None:
            drop_folder(spark, f"{place}/scan{scan - 1}/open=true")
        both = spark.read.schema(table).parquet(path)
        state = both.filter("open")
        whole.append(both.filter(F.col("open") == F.lit(False)).select("phrase", "n"))
        reached = both.filter((F.col("n") >= least) & (F.col("before") < least) & (F.length("phrase") < 8 * longest))
        new = _new_slots(reached, filter_bits)
        fresh = new[filter_[new] == UNSET]
        if len(fresh):
            filter_[fresh] = scan
            last_set = scan
        scan += 1
        if scan >= UNSET:
            raise ValueError("too many scans for the filter's stamps: use fewer shards or shorter phrases")
    found = whole[0]
    for more in whole[1:]:
        found = found.unionByName(more)
    return kept(found.hint("rebalance")), totals


def _dictionary(words: DataFrame, phrases: DataFrame, bits: int) -> DataFrame:
    """(mark, lang, word) of the words of some phrases, and of few others; mark is a word's number as binary.

    What the tasks look for in the spellings of a word table is a filter of a fixed size again.
    """
    each = F.explode(F.transform(F.sequence(F.lit(1), F.col("size")), lambda k: F.substring("phrase", 8 * k - 7, F.lit(8))))
    wanted = np.full(1 << bits, UNSET, np.uint8)
    wanted[_new_slots(phrases.select(each.alias("phrase")).distinct(), bits)] = 0
    shared = words.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, n, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                numbers, spelled = np.frombuffer(raw, "<u8", n), raw[8 * n:].split(b" ")
                known = np.flatnonzero(stamped(shared.value, numbers) != UNSET)
                yield pa.RecordBatch.from_arrays([
                    _binary(numbers[known][:, None]), pa.array([lang] * len(known), pa.string()),
                    pa.array([spelled[i].decode() for i in known.tolist()], pa.string())], names=["mark", "lang", "word"])

    return words.filter(F.col("shard") == SPELLED).select("lang", "owned", "words") \
        .mapInArrow(run, "mark binary, lang string, word string") \
        .groupBy("mark").agg(F.min("lang").alias("lang"), F.min("word").alias("word"))


def _part(first: Column | int, size: Column | None = None) -> Column:
    """Words of a phrase, from word `first` (from 0) on."""
    start = F.lit(first) * 8 + 1
    return F.substring("phrase", start, size * 8) if size is not None else F.substring("phrase", start, F.length("phrase"))


def collocations(
    docs: DataFrame, text: str = "text", lang: str = "lang", least: int = 100, longest: int = 5, top: int = 2000,
    absorb_percent: int = 100, shards: int = 3, filter_bits: int = 24, unknown: str = "und",
) -> DataFrame:
    """Per language the `top` phrases: lang, rank, phrase, a, l, r, n, score.

    Words are runs without space and tab, lower-cased in A-Z, and no phrase spans one of `.,;:!?` or a line end. A
    phrase of 2 to `longest` words with a = its occurrences >= `least` is scored by its weakest cut into l and r
    (occurrences of the parts): floor(1000 a n / (l r)), n being all words of the language; equal scores go to
    the first cut. A phrase inside a longer one that has at least `absorb_percent` % of its occurrences
    is dropped. Order: score, a, both descending, then phrase.

    A null language is `unknown`; null and empty texts have no words; repeated rows count each; an empty
    table, or one without frequent phrases, gives no rows. Other columns are not read.
    """
    if least < 1 or longest < 2 or shards < 1 or shards * (longest + 1) >= UNSET:
        raise ValueError("at least 1 occurrence, 2 words and 1 shard, and fewer scans than stamps")
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit(unknown)).alias("lang"),
                       F.col(text).cast("string").alias("text"))
    place = shared_folder(docs.sparkSession)
    table = word_table(rows, "lang", "text", place, longest, shards)
    found, totals = phrase_counts(table, place, least, longest, shards, filter_bits)
    size = (F.length("phrase") / 8).cast("int")
    phrases = found.filter(F.length("phrase") > 8).select("phrase", F.col("n").alias("a"), size.alias("size"))
    # A longer phrase is at most as frequent as the phrases between, so one more word is enough to look at.
    inner = F.explode(F.array(_part(0, F.col("size") - 1), _part(1, F.col("size") - 1))).alias("phrase")
    around = phrases.filter("size > 2").select("a", inner).groupBy("phrase").agg(F.max("a").alias("around"))
    exact = lambda c: F.col(c).cast("decimal(18,0)")
    left = phrases.join(around, "phrase", "left") \
        .filter(F.col("around").isNull() | (exact("around") * 100 < exact("a") * absorb_percent)).select("phrase", "a", "size")
    cuts = left.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("size") - 1))) \
        .withColumn("head", _part(0, F.col("cut"))).withColumn("tail", _part(F.col("cut")))
    cuts = cuts.join(found.select(F.col("phrase").alias("head"), F.col("n").alias("l")), "head") \
        .join(found.select(F.col("phrase").alias("tail"), F.col("n").alias("r")), "tail")
    spelled = _dictionary(table, left, filter_bits)
    each = F.posexplode(F.transform(F.sequence(F.lit(1), F.col("size")), lambda k: F.substring("phrase", 8 * k - 7, F.lit(8))))
    words = left.select("phrase", each.alias("at", "mark")).join(spelled, "mark").groupBy("phrase").agg(
        F.min("lang").alias("lang"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda w: w["word"]), " ").alias("spelled"))
    scored = cuts.join(words, "phrase").join(totals, "lang")
    # 1000 * a * n has at most 38 digits for a below 10^15 and n below 10^18.
    score = F.expr("(cast(1000 as decimal(4,0)) * cast(a as decimal(15,0)) * cast(n as decimal(18,0)))"
                   " div (cast(l as decimal(18,0)) * cast(r as decimal(18,0)))")
    best = scored.withColumn("score", score).groupBy("lang", "phrase", "spelled", "a", "n") \
        .agg(F.min(F.struct("score", "cut", "l", "r")).alias("best")) \
        .select("lang", F.col("spelled").alias("phrase"), "a", "best.l", "best.r", "n", "best.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top) \
        .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
