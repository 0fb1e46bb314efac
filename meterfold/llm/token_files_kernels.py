"""Token-id files and their minimal perfect hash index, inside tasks.

Payload file ``ids-<shard>.bin``: the ids of the shard's documents one after another, little-endian, of one
width (2 or 4 bytes), nothing else. Index file ``index-<file>.bin``: ``buckets + 1`` positions (u64) and
the buckets. A bucket of n keys: n, groups (u32 each), one pilot (u32) per group, one ``ENTRY`` per slot.
"""

import re
import sys
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs

from meterfold.llm.common import ship

GROUP_KEYS = 4  # keys that share a pilot, on average
TRIALS = 256  # pilots tried at once
CACHE_WORDS = 1 << 20
LINE_WORDS = 64
READ_BYTES = 1 << 22
ENTRY = np.dtype([("fingerprint", "<u8"), ("shard", "<u4"), ("offset", "<u8"), ("start", "<u8"), ("n", "<u8")])


def _opened(root):
    """(file system, path) of a folder that pyarrow can reach from every task."""
    return pyarrow.fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", root))


def payload_name(path, shard):
    return f"{path}/ids-{shard:07d}.bin"


def index_name(path, file):
    return f"{path}/index-{file:07d}.bin"


def _finish(fs, temporary, name):
    """Give a complete file its name; one that stands there is an equal file of an attempt before."""
    if fs.get_file_info(name).type == pyarrow.fs.FileType.NotFound:
        fs.move(temporary, name)
    else:
        fs.delete_file(temporary)


# --- encoding ------------------------------------------------------------------------------

def _encoder(tokenizer_path, kind, end_id, words_apart):
    """texts (Arrow strings) -> ids of all texts, the end id after each, and how many each text has.

    With ``words_apart`` (a tokenizer whose tokens never reach over ASCII white space) the library
    encodes every distinct word once, in a bounded cache, and the ids of the texts are gathered from those.
    """
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    end = np.array([end_id], kind)

    def whole(texts):
        ids = [np.array(e.ids, kind) for e in tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
        return np.concatenate([part for x in ids for part in (x, end)]), np.array([len(x) + 1 for x in ids])

    cache = {}

    def learn(words):
        """Encode new words, some to a line: a token belongs to the word in which it starts."""
        groups = [words[i:i + LINE_WORDS] for i in range(0, len(words), LINE_WORDS)]
        for group, line in zip(groups, tokenizer.encode_batch(list(map(" ".join, groups)), add_special_tokens=False)):
            ids = np.array(line.ids, kind).tobytes()
            starts = np.fromiter((o[0] for o in line.offsets), np.int64, len(line))
            cuts = (np.searchsorted(starts, np.cumsum([0, *(len(w) + 1 for w in group)])) * kind.itemsize).tolist()
            cache.update((w, ids[x:y]) for w, x, y in zip(group, cuts[:-1], cuts[1:]))

    def by_words(texts):
        split = pc.ascii_split_whitespace(texts)
        found = split.flatten().dictionary_encode()
        words = found.dictionary.to_pylist()
        if len(cache) > CACHE_WORDS:
            cache.clear()
        learn([w for w in words if w not in cache])
        known = [*map(cache.__getitem__, words), end.tobytes()]
        lengths = np.fromiter(map(len, known), np.int64, len(known)) // kind.itemsize
        flat, starts = np.frombuffer(b"".join(known), kind), np.cumsum(lengths) - lengths
        ends = np.cumsum(np.asarray(split.value_lengths(), np.int64))
        which = np.insert(found.indices.to_numpy(), ends, len(words))
        n = lengths[which]
        total = np.concatenate([[0], np.cumsum(n)])
        ids = flat[np.repeat(starts[which] - total[:-1], n) + np.arange(total[-1])]
        return ids, np.diff(total[ends + np.arange(1, len(ends) + 1)], prepend=0)

    return by_words if words_apart else whole


def _portions(texts, limit=1 << 23):
    """Slices of neighbouring texts of about ``limit`` bytes."""
    size = np.cumsum(np.asarray(pc.binary_length(texts), np.int64))
    begin = 0
    while begin < len(texts):
        held = size[begin - 1] if begin else 0
        until = max(begin + 1, int(np.searchsorted(size, held + limit, "right")))
        yield texts.slice(begin, until - begin)
        begin = until


def write_ids(root, tokenizer_path, end_id, width, words_apart):
    """mapInArrow over (doc_id, text) in file order: writes the task's payload file.

    Per document: doc_id, nth row of that id in the shard, shard, offset, n_tokens.
    """
    kind = np.dtype(f"<u{width}")

    def run(batches):
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        encode = _encoder(tokenizer_path, kind, end_id, words_apart)
        fs, path = _opened(root)
        temporary = f"{path}/part-{uuid.uuid4().hex}"
        offset, nth, last, sink = 0, -1, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            if sink is None:
                fs.create_dir(path)
                sink = fs.open_output_stream(temporary)
            counts = []
            for part in _portions(batch.column("text").fill_null("")):
                ids, n = encode(part)
                sink.write(ids.tobytes())
                counts.append(n)
            counts = np.concatenate(counts)
            nths = []
            for key in batch.column("doc_id").to_pylist():
                nth = nth + 1 if nth >= 0 and key == last else 0
                last = key
                nths.append(nth)
            offsets = offset + np.cumsum(counts) - counts
            offset += int(counts.sum())
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array(nths, pa.int64()),
                pa.array(np.full(len(counts), shard, np.int32)), pa.array(offsets), pa.array(counts)],
                ["doc_id", "nth", "shard", "offset", "n_tokens"])
        if sink is not None:
            sink.close()
            _finish(fs, temporary, payload_name(path, shard))

    return run


# --- index ---------------------------------------------------------------------------------

def _mixed(x):
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _seeds(h1, h2):
    """Per key: the hash that chooses a slot together with a pilot, the group hash, the fingerprint."""
    a, b = h1.view(np.uint64), h2.view(np.uint64)
    return _mixed(a ^ _mixed(b)), _mixed(b + np.uint64(1)), _mixed(b ^ _mixed(a + np.uint64(2)))


def _slots(seed, pilot, n):
    return _mixed(seed ^ _mixed(pilot + np.uint64(3))) % np.uint64(n)


def build(seed, group):
    """(pilots, slot of every key): hash and displace, fullest groups first.

    A group's pilot is the first one that sends its keys to different free slots; all n slots are used.
    """
    n = len(seed)
    groups = -(-n // GROUP_KEYS)
    group = group % np.uint64(groups)
    pilots, slots, free = np.zeros(groups, np.uint32), np.zeros(n, np.int64), np.ones(n, bool)
    order = np.argsort(group, kind="stable")
    starts = np.searchsorted(group[order], np.arange(groups + 1, dtype=np.uint64))
    sizes = np.diff(starts)
    for g in np.argsort(-sizes, kind="stable"):
        if not sizes[g]:
            break
        members = order[starts[g]:starts[g + 1]]
        if len(np.unique(seed[members])) < len(members):
            raise ValueError("two keys with equal hashes")
        for first in range(0, 1 << 32, TRIALS):
            tried = np.arange(first, first + TRIALS, dtype=np.uint64)
            at = _slots(seed[members][None, :], tried[:, None], n).astype(np.int64)
            good = free[at].all(axis=1)
            if len(members) > 1:
                ordered = np.sort(at, axis=1)
                good &= (ordered[:, 1:] != ordered[:, :-1]).all(axis=1)
            if good.any():
                k = int(good.argmax())
                pilots[g] = first + k
                slots[members] = at[k]
                free[at[k]] = False
                break
    return pilots, slots


def _segment(part):
    """One bucket as bytes."""
    n = len(part["h1"])
    seed, group, fingerprint = _seeds(part["h1"], part["h2"])
    pilots, slots = build(seed, group)
    entries = np.zeros(n, ENTRY)
    entries["fingerprint"][slots] = fingerprint
    for field, column in (("shard", "shard"), ("offset", "offset"), ("start", "start"), ("n", "n_tokens")):
        entries[field][slots] = part[column]
    return np.array([n, len(pilots)], "<u4").tobytes() + pilots.astype("<u4").tobytes() + entries.tobytes()


def write_index(root, per_file):
    """applyInArrow over the keys of one index file (file, bucket, h1, h2, and what an entry holds)."""

    def run(table):
        columns = {c: table.column(c).to_numpy() for c in table.column_names}
        file = int(columns["file"][0])
        place = columns["bucket"] - file * per_file
        order = np.argsort(place, kind="stable")
        cuts = np.searchsorted(place[order], np.arange(per_file + 1))
        segments = []
        for a, b in zip(cuts[:-1], cuts[1:]):
            segments.append(_segment({c: v[order[a:b]] for c, v in columns.items()}) if a < b else b"")
        positions = 8 * (per_file + 1) + np.cumsum([0, *map(len, segments)])
        fs, path = _opened(root)
        temporary = f"{path}/part-{uuid.uuid4().hex}"
        fs.create_dir(path)
        with fs.open_output_stream(temporary) as sink:
            sink.write(positions.astype("<u8").tobytes())
            for segment in segments:
                sink.write(segment)
        _finish(fs, temporary, index_name(path, file))
        return pa.table({"file": pa.array([file], pa.int32()), "keys": pa.array([len(order)], pa.int64())})

    return run


class _Index:
    """One open index file; a key costs its group's pilot and one entry of a bucket that is kept."""

    def __init__(self, fs, path):
        self.fs, self.path = fs, path
        self.file, self.source, self.bucket, self.pilots, self.entries = None, None, None, None, None

    def _open(self, bucket, per_file):
        file, place = divmod(bucket, per_file)
        if file != self.file:
            self.close()
            name = index_name(self.path, file)
            self.file = file
            if self.fs.get_file_info(name).type != pyarrow.fs.FileType.NotFound:
                self.source = self.fs.open_input_file(name)
        segment = b""
        if self.source is not None:
            begin, end = np.frombuffer(self.source.read_at(16, 8 * place), "<u8").tolist()
            segment = self.source.read_at(end - begin, begin)
        n, groups = np.frombuffer(segment[:8], "<u4").tolist() if segment else (0, 0)
        self.bucket = bucket
        self.pilots = np.frombuffer(segment, "<u4", groups, 8) if n else np.zeros(0, "<u4")
        self.entries = np.frombuffer(segment, ENTRY, n, 8 + 4 * groups) if n else np.zeros(0, ENTRY)

    def find(self, bucket, per_file, h1, h2):
        """Entries of keys of one bucket, and which of them are stored."""
        if bucket != self.bucket:
            self._open(bucket, per_file)
        if not len(self.entries):
            return np.zeros(len(h1), ENTRY), np.zeros(len(h1), bool)
        seed, group, fingerprint = _seeds(h1, h2)
        pilot = self.pilots[(group % np.uint64(len(self.pilots))).astype(np.int64)].astype(np.uint64)
        found = self.entries[_slots(seed, pilot, len(self.entries)).astype(np.int64)]
        return found, found["fingerprint"] == fingerprint

    def close(self):
        if self.source is not None:
            self.source.close()
        self.source = None


def look_up(root, per_file, keep):
    """mapInArrow over (*keep, bucket, h1, h2), by bucket: the keys with start, n_tokens, shard, offset."""

    def run(batches):
        fs, path = _opened(root)
        index = _Index(fs, path)
        for batch in batches:
            bucket, h1, h2 = (batch.column(c).to_numpy() for c in ("bucket", "h1", "h2"))
            entries, known = np.zeros(len(bucket), ENTRY), np.zeros(len(bucket), bool)
            cuts = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1)) if len(bucket) else []
            for a, b in zip(cuts[:-1], cuts[1:]):
                entries[a:b], known[a:b] = index.find(int(bucket[a]), per_file, h1[a:b], h2[a:b])
            found = [pa.array(entries[f].astype(np.int64), mask=~known) for f in ("start", "n", "shard", "offset")]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), *found], [*keep, "start", "n_tokens", "shard", "offset"])
        index.close()

    return run


# --- reading -------------------------------------------------------------------------------

def read_ids(root, width, keep):
    """mapInArrow over (*keep, shard, offset, n_tokens), by shard and offset: keep and the ids (u32 bytes).

    Neighbouring documents are read together, some ``READ_BYTES`` at a time.
    """

    def run(batches):
        fs, path = _opened(root)
        open_shard, source = None, None
        for batch in batches:
            shard, offset, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("shard", "offset", "n_tokens"))
            at = 0
            while at < len(shard):
                until, held = at + 1, n[at]
                while (until < len(shard) and shard[until] == shard[at] and offset[until] == offset[until - 1] + n[until - 1]
                       and (held + n[until]) * width <= READ_BYTES):
                    held += n[until]
                    until += 1
                if shard[at] != open_shard:
                    if source is not None:
                        source.close()
                    open_shard, source = shard[at], fs.open_input_file(payload_name(path, int(shard[at])))
                raw = np.frombuffer(source.read_at(int(held) * width, int(offset[at]) * width), f"<u{width}")
                ends = 4 * np.cumsum([0, *n[at:until]])
                yield pa.RecordBatch.from_arrays([
                    *(batch.column(c).slice(at, until - at) for c in keep),
                    pa.LargeBinaryArray.from_buffers(pa.large_binary(), until - at, [
                        None, pa.py_buffer(ends.astype(np.int64).tobytes()),
                        pa.py_buffer(raw.astype("<u4").tobytes())]).cast(pa.binary())], [*keep, "ids"])
                at = until
        if source is not None:
            source.close()

    return run


ship(sys.modules[__name__])
