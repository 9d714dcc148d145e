"""Token sequences in Arrow files: equal-length rows of token ids and masks
that readers map into memory and address directly.

The documents' token ids, in ascending doc_id order, are cut into shards
(ranges of doc_id) and each shard into rows of ``length`` tokens. A
shard is two Arrow IPC files: ``tokens-N.arrow`` holds record batches of
fixed-size lists (``tokens``, and ``mask``, 1 where a token stands; the
last row of a shard is filled up), ``docs-N.arrow`` the doc_id, the shard
position and the number of tokens of each document. Batches are of ROWS rows,
so token k of a shard is element k % length of row k / length.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from kolekta.llm.common import blocks, byte_texts, give_back, key_slices, read_table, shared_folder, stored, worker_state

LENGTH = 2048
ROWS = 128
END = 1
#: Bytes of text encoded at once, and in a shard.
TEXT_BYTES, SHARD_BYTES = 1 << 20, 16 << 20
#: Stands for a null id where ranges are told apart.
LEAST = -1 << 63
#: Marks that may end a word of letters (no apostrophe: what follows one can belong to it), at most LONGEST_TAIL of them.
MARKS, LONGEST_TAIL = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~", 3
#: Bytes of texts that composition leaves alone: ASCII, and the letters U+00C0 to U+00FF.
COMPOSED = bytes([*range(128), 0xC3, *range(0x80, 0xC0)])
#: Bytes of words of letters up to U+00FF, and of those in lower case (no bytes of the signs U+00D7 and U+00F7).
LETTERS = bytes([*range(65, 91), *range(97, 123), 0xC3, *(c for c in range(0x80, 0xC0) if c not in (0x97, 0xB7))])
LOWERED = bytes([*range(97, 123), 0xC3, *(c for c in range(0x9F, 0xC0) if c != 0xB7)])
#: Words whose ids a Python worker remembers; beyond that it keeps the half used most.
REMEMBERED = 400_000


class WordCodec:
    """Ids of whole texts under a tokenizer that drops white space.

    For such a tokenizer the ids of a text are those of its words one after
    the other, so a word is encoded by the library once and remembered. When
    REMEMBERED words are, those that came up most often stay. Where the
    tokenizer lowers letters, and splits marks off the letters before them, a
    word of letters up to U+00FF is encoded in lower case and without its last marks,
    by the library's model alone where nothing else touches it; which of this
    holds is asked of the library. Raises for a tokenizer that keeps white space.
    """

    def __init__(self, tokenizer_json: str, add_special_tokens: bool = False):
        import numpy as np
        from tokenizers import Tokenizer
        self.tokenizer, self.special = Tokenizer.from_str(tokenizer_json), add_special_tokens
        self.place: dict[bytes, int] = {}
        self.start, self.size, self.used = (np.zeros(0, np.int32) for _ in range(3))
        self.ids = np.zeros(0, np.int32)
        ids = lambda t: self.tokenizer.encode(t, add_special_tokens=self.special).ids
        if ids("ab c") != ids("ab") + ids("c") or ids(" \t\n") != []:
            raise ValueError("the tokenizer does not drop white space")
        pre, norm = self.tokenizer.pre_tokenizer, self.tokenizer.normalizer
        self.pre, self.norm = pre, (norm.normalize_str if norm is not None else lambda t: t)
        self.lower = self.norm("ABXZ") == "abxz"
        self.added = [t.content.lower().encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        plain = "abcdefghijklmnopqrstuvwxyz"
        self.direct = (not self.special and self.norm(plain) == plain
                       and pre is not None and pre.pre_tokenize_str(plain) == [(plain, (0, len(plain)))])
        self.bytes = self._byte_letters() if self.direct else None
        self.lowered = LOWERED if self.bytes else LOWERED[:26]
        self.tails: dict[bytes, bool] = {}
        for c in b".,;:!?":
            self._splits(bytes([c]))

    def _byte_letters(self) -> dict[int, str] | None:
        """What the pre-tokenizer makes of each byte of the letters U+00DF to U+00FF; None where it or the normaliser does more."""
        upper, low = ("".join(chr(c) for c in r if chr(c).isalpha()) for r in (range(0xC0, 0xDF), range(0xDF, 0x100)))
        every = upper + low + upper[::-1] + low[::-1]
        if self.norm(every) != (every.lower() if self.lower else every):
            return None
        pieces = self.pre.pre_tokenize_str("ab" + low + "z" + low[::-1])
        raw = ("ab" + low + "z" + low[::-1]).encode()
        if len(pieces) != 1 or len(pieces[0][0]) != len(raw):
            return None
        made = dict(zip(raw, pieces[0][0]))
        return made if [made[c] for c in raw] == list(pieces[0][0]) else None

    def _splits(self, tail: bytes) -> bool:
        """Whether the library leaves the marks as they are and makes them one piece after letters."""
        if tail not in self.tails:
            t = tail.decode()
            self.tails[tail] = self.direct and self.norm("ab" + t) == "ab" + t and all(
                [at for _, at in self.pre.pre_tokenize_str(w + t)] == [(0, len(w)), (len(w), len(w + t))] for w in ("ab", "s", "the"))
        return self.tails[tail]

    def _core(self, word: bytes) -> tuple[bytes, bytes]:
        """(word to encode, marks that follow) with the same ids one after the other as ``word``."""
        core = word.rstrip(MARKS)
        tail = word[len(core):]
        if tail and (len(tail) > LONGEST_TAIL or not self._splits(tail)):
            return word, b""
        if core.isalpha():   # ASCII letters only
            return (core.lower() if self.lower else core), tail
        if core and self.bytes and not core.translate(None, LETTERS):
            return (core.decode().lower().encode() if self.lower else core), tail
        return word, b""

    def _learn(self, words: list[bytes]) -> None:
        import itertools

        import numpy as np
        split = list(map(self._core, words))
        cores = [c for c in dict.fromkeys(itertools.chain.from_iterable(split)) if c and c not in self.place]
        plain = [c for c in cores if not c.translate(None, self.lowered)] if self.direct else []
        if plain:   # letters, which neither the normaliser nor the pre-tokenizer changes but for their bytes
            model, known = self.tokenizer.model.tokenize, set(plain)
            pieces = [[t.id for t in model(c.decode() if c.isascii() else c.decode("latin-1").translate(self.bytes))] for c in plain]
            self._add(plain, np.array([i for p in pieces for i in p], np.int32), np.fromiter(map(len, pieces), np.int32, len(pieces)))
            cores = [c for c in cores if c not in known]
        if cores:
            self._encode(cores)
        rest = [(w, c, t) for w, (c, t) in zip(words, split) if w != c]
        if not rest:
            return
        core = np.array([self.place[c] for _, c, _ in rest])
        tail = np.array([self.place[t] if t else -1 for _, _, t in rest])
        at = np.stack([core, tail], 1).ravel()
        size = np.where(at >= 0, self.size[at], 0)
        ends = np.cumsum(size, dtype=np.int64)
        ids = self.ids[np.repeat(self.start[at] - (ends - size), size) + np.arange(int(ends[-1]))]
        self._add([w for w, _, _ in rest], ids, size.reshape(-1, 2).sum(1))

    def _add(self, words: list[bytes], ids, size) -> None:
        import numpy as np
        size = size.astype(np.int32)
        self.place.update(zip(words, range(len(self.place), len(self.place) + len(words))))
        self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(size, dtype=np.int32) - size])
        self.size, self.ids = np.concatenate([self.size, size]), np.concatenate([self.ids, ids.astype(np.int32)])
        self.used = np.concatenate([self.used, np.zeros(len(words), np.int32)])

    def _encode(self, words: list[bytes]) -> None:
        import numpy as np
        flat, sizes = [], []
        for a in range(0, len(words), 10_000):
            part = words[a:a + 10_000]
            got = self.tokenizer.encode([w.decode() for w in part], is_pretokenized=True, add_special_tokens=self.special)
            flat.append(np.array(got.ids, np.int32))
            sizes.append(np.bincount(np.array(got.word_ids, np.int64), minlength=len(part)).astype(np.int32))
        self._add(words, np.concatenate(flat), np.concatenate(sizes))

    def _forget(self) -> None:
        """Keep the more often used half of what may be remembered."""
        import numpy as np
        kept = np.sort(np.argsort(-self.used, kind="stable")[:REMEMBERED // 2])
        words = list(self.place)
        self.place = {words[k]: n for n, k in enumerate(kept.tolist())}
        size = self.size[kept]
        ends = np.cumsum(size, dtype=np.int32)
        self.ids = self.ids[np.repeat(self.start[kept] - (ends - size), size) + np.arange(int(size.sum()), dtype=np.int32)]
        self.start, self.size, self.used = ends - size, size, self.used[kept]

    def _lowered(self, text: bytes) -> bytes:
        """The text with A-Z in lower case, where that changes no id: composition, which may depend on the case
        of a letter, leaves it as it is, and it holds no added token in any case."""
        low = text.lower()
        if not self.lower or text.translate(None, COMPOSED) or any(a in low for a in self.added):
            return text
        return low

    def encode(self, texts: list[bytes]):
        """(ids of all texts one after the other, number of each)."""
        import itertools

        import numpy as np
        words = [self._lowered(t).split() for t in texts]
        counts = np.fromiter(map(len, words), np.int64, len(words))
        flat = list(itertools.chain.from_iterable(words))
        if len(self.place) > REMEMBERED:
            self._forget()
        at = np.fromiter(map(self.place.get, flat, itertools.repeat(-1)), np.int32, len(flat))
        missing = np.flatnonzero(at < 0).tolist()
        if missing:
            self._learn(list(dict.fromkeys(flat[k] for k in missing)))
            at[missing] = [self.place[flat[k]] for k in missing]
        self.used += np.bincount(at, minlength=len(self.used)).astype(np.int32)
        size = self.size[at]
        ends = np.cumsum(size, dtype=np.int64)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.ids[np.repeat(self.start[at] - (ends - size), size) + np.arange(total)]
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
        return ids, np.diff(bounds)


def default_tokenizer() -> str:
    import public_tokenizers
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        return f.read()


def _vocabulary(tokenizer_json: str) -> int:
    from tokenizers import Tokenizer
    return Tokenizer.from_str(tokenizer_json).get_vocab_size()


def file_system(folder: str):
    """(Arrow file system, path) of a folder that Spark names; it opens what
    Arrow has a client for (a shared mount, object stores, HDFS)."""
    import re

    from pyarrow import fs
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", folder))


class ShardWriter:
    """Writes one shard; the files appear under their names when it is closed."""

    def __init__(self, folder: str, shard: int, attempt: int, length: int, kind):
        import pyarrow as pa
        self.fs, root = file_system(folder)
        self.fs.create_dir(root, recursive=True)
        self.paths = [(f"{root}/.{n}-{shard}-{attempt}", f"{root}/{n}-{shard}.arrow") for n in ("tokens", "docs")]
        self.kind = kind
        self.length, self.pending, self.waiting, self.position = length, [], 0, 0
        self.schemas = [pa.schema([("tokens", pa.list_(pa.from_numpy_dtype(self.kind), length)), ("mask", pa.list_(pa.uint8(), length))]),
                        pa.schema([("doc_id", pa.int64()), ("position", pa.int64()), ("n_tokens", pa.int64())])]
        self.sinks = [self.fs.open_output_stream(t) for t, _ in self.paths]
        self.files = [pa.ipc.new_file(sink, s) for sink, s in zip(self.sinks, self.schemas)]

    def _rows(self, ids) -> None:
        import numpy as np
        import pyarrow as pa
        fill = -len(ids) % self.length
        mask = np.ones(len(ids) + fill, np.uint8)
        mask[len(ids):] = 0
        ids = np.concatenate([ids, np.zeros(fill, self.kind)])
        columns = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (ids, mask)]
        self.files[0].write_batch(pa.RecordBatch.from_arrays(columns, schema=self.schemas[0]))

    def add(self, doc_ids, ids, sizes) -> None:
        """Documents (an Arrow array of ids), their tokens one after the other, and the number of each."""
        import numpy as np
        import pyarrow as pa
        ends = self.position + np.cumsum(sizes)
        self.files[1].write_batch(pa.RecordBatch.from_arrays(
            [doc_ids.cast(pa.int64()), pa.array(ends - sizes), pa.array(sizes)], schema=self.schemas[1]))
        self.position += int(sizes.sum())
        self.pending.append(ids.astype(self.kind))
        self.waiting += len(ids)
        most = self.length * ROWS
        if self.waiting >= most:
            ids = np.concatenate(self.pending)
            whole = len(ids) // most * most
            for k in range(0, whole, most):
                self._rows(ids[k:k + most])
            self.pending, self.waiting = [ids[whole:]], len(ids) - whole

    def close(self) -> int:
        """Ends the files; returns the shard's number of tokens."""
        import numpy as np
        if self.waiting:
            self._rows(np.concatenate(self.pending))
        for f, sink, (temporary, final) in zip(self.files, self.sinks, self.paths):
            f.close()
            sink.close()
            self.fs.move(temporary, final)
        return self.position


class ShardReader:
    """Random access to a shard's rows, tokens and documents, without copying what is mapped."""

    def __init__(self, folder: str, shard: int):
        import pyarrow as pa
        files, root = file_system(folder)
        local = files.type_name == "local"
        opened = [pa.memory_map(f"{root}/{n}-{shard}.arrow") if local else files.open_input_file(f"{root}/{n}-{shard}.arrow")
                  for n in ("tokens", "docs")]
        self.tokens_file, self.docs_file = (pa.ipc.open_file(f) for f in opened)
        self.length = self.tokens_file.schema.field("tokens").type.list_size
        self.batch = (-1, None, None)

    def _batch(self, k: int):
        if self.batch[0] != k:
            b = self.tokens_file.get_batch(k)
            self.batch = (k, *(b.column(i).values.to_numpy(zero_copy_only=True) for i in (0, 1)))
        return self.batch

    def sequence(self, row: int):
        """(tokens, mask) of one row, both views of the file; the mask as booleans."""
        _, flat, mask = self._batch(row // ROWS)
        at = row % ROWS * self.length
        return flat[at:at + self.length], mask[at:at + self.length].view(bool)

    def tokens(self, start: int, count: int):
        """``count`` tokens from position ``start`` of the shard."""
        import numpy as np
        most, out = self.length * ROWS, []
        while count > 0:
            _, flat, _ = self._batch(start // most)
            at = start % most
            part = flat[at:at + min(count, most - at)]
            out.append(part)
            start, count = start + len(part), count - len(part)
        return out[0] if len(out) == 1 else np.concatenate(out) if out else np.zeros(0, np.uint16)

    def documents(self):
        """Record batches of doc_id, position and n_tokens."""
        for k in range(self.docs_file.num_record_batches):
            yield self.docs_file.get_batch(k)


def _ranges(docs: DataFrame, shard_bytes: int):
    """(doc_ids, hashes): the least (doc_id, text hash) of each shard, in order; null ids are the least number.

    Only ids and hashes are dealt for this; one row a shard reaches the driver."""
    import numpy as np
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)) + F.count("*")).first()[0]
    keys = docs.select(F.coalesce("doc_id", F.lit(LEAST)).alias("doc_id"), "hash")
    firsts = (keys.repartitionByRange(max(1, -(-size // shard_bytes)), "doc_id", "hash").groupBy(F.spark_partition_id())
              .agg(F.min(F.struct("doc_id", "hash")).alias("k")).select("k.doc_id", "k.hash").collect())
    firsts = sorted(map(tuple, firsts))
    return np.array([i for i, _ in firsts], np.int64), np.array([h for _, h in firsts], np.int64)


def shard_of(ids, hashes, first_ids, first_hashes):
    """The shard of each (id, hash): the last one that starts at or before it."""
    import numpy as np
    low, high = (np.searchsorted(first_ids, ids, side=s) for s in ("left", "right"))
    for k in np.flatnonzero(high > low):   # ids at which a shard starts
        low[k] += np.searchsorted(first_hashes[low[k]:high[k]], hashes[k], side="right")
    return np.maximum(low - 1, 0)


def write_sequences(docs: DataFrame, folder: str, tokenizer_json: str | None = None, end: int = END,
                    length: int = LENGTH, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Encode ``docs(doc_id, text)`` into shards under ``folder``; returns the
    manifest (shard, n_docs, n_tokens, start), start being the tokens of all shards before.

    Shards are ranges of doc_id and text hash of about ``shard_bytes`` of text,
    sorted, nulls first, repeated ids by text hash; null text counts as empty;
    each document gets the id ``end`` at its end. Texts are encoded where
    they are read, and only their ids are dealt to the shards. A task that runs again writes
    the same files anew under the same names. An empty table gives an empty manifest.
    """
    spark, tokenizer_json = docs.sparkSession, tokenizer_json or default_tokenizer()
    held = spark.sparkContext.broadcast(tokenizer_json)
    key = "words_" + hashlib.sha256(tokenizer_json.encode()).hexdigest()
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("hash"), "text")
    ranges = _ranges(docs, shard_bytes)
    shards, kind = max(1, len(ranges[0])), "<u2" if _vocabulary(tokenizer_json) <= 1 << 16 else "<i4"
    firsts = spark.sparkContext.broadcast(ranges)

    def encode(batches):
        import numpy as np
        import pyarrow as pa
        for b in batches:
            texts = byte_texts(b.column(2))
            for i, k in blocks(texts, TEXT_BYTES):
                codec = worker_state(key, lambda: WordCodec(held.value))
                ids, sizes = codec.encode(texts[i:k])
                ids = np.insert(ids, np.cumsum(sizes), end).astype(kind)
                ends = np.cumsum(sizes + 1)
                part = b.slice(i, k - i)
                at = shard_of(part.column(0).fill_null(LEAST).to_numpy(), part.column(1).to_numpy(), *firsts.value)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(at), part.column(0), part.column(1),
                     pa.array([ids[z - n:z].tobytes() for z, n in zip(ends.tolist(), (sizes + 1).tolist())], pa.binary())],
                    ["shard", "doc_id", "hash", "ids"])
        give_back()

    rows = (docs.mapInArrow(encode, "shard long, doc_id long, hash long, ids binary")
            .repartitionById(shards, F.col("shard").cast("int")).sortWithinPartitions("shard", "doc_id", "hash"))

    def write(batches):
        import itertools

        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext
        for (shard,), parts in itertools.groupby(key_slices(batches, 1), lambda x: x[0]):
            writer, n_docs = None, 0
            for _, b in parts:
                if writer is None:
                    writer = ShardWriter(folder, shard, TaskContext.get().taskAttemptId(), length, np.dtype(kind))
                ids = [np.frombuffer(x.as_buffer(), kind) for x in b.column(3)]
                writer.add(b.column(1), np.concatenate(ids), np.fromiter(map(len, ids), np.int64, len(ids)))
                n_docs += b.num_rows
            yield pa.RecordBatch.from_pylist([{"shard": shard, "n_docs": n_docs, "n_tokens": writer.close()}])
        give_back()

    manifest = stored(rows.mapInArrow(write, "shard long, n_docs long, n_tokens long"), "manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row for each shard
    return stored(manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))), "manifest")


def read_documents(manifest: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files.

    start counts the ids of all documents before; ids_crc32 is the crc32 of
    the ids as little-endian unsigned 32-bit integers. One task reads each shard.
    """
    def read(batches):
        import zlib

        import numpy as np
        import pyarrow as pa
        for b in batches:
            for row in b.to_pylist():
                shard = ShardReader(folder, row["shard"])
                for d in shard.documents():
                    at, n = d.column("position").to_numpy(), d.column("n_tokens").to_numpy()
                    crc = np.fromiter((zlib.crc32(shard.tokens(a, k).astype("<u4").tobytes())
                                       for a, k in zip(at.tolist(), n.tolist())), np.int64, len(at))
                    yield pa.RecordBatch.from_arrays(
                        [d.column("doc_id"), pa.array(at + row["start"]), d.column("n_tokens"), pa.array(crc)],
                        ["doc_id", "start", "n_tokens", "ids_crc32"])

    shards = max(1, manifest.count())
    return (manifest.select("shard", "start").repartitionByRange(shards, "shard")
            .mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long"))


def query(spark, sf_dir: str) -> DataFrame:
    """op5: write all documents as sequences, read them back."""
    folder = shared_folder(spark, "sequences")
    return read_documents(write_sequences(read_table(spark, sf_dir, "documents"), folder), folder)
