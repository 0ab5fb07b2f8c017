"""Near-duplicate texts: a prefix-tree join of word n-gram sets by Jaccard similarity."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.llm.blocks import SPACED, batch_map, give_back, mixed, small_batches, summed, text_slices, words
from loomwright.llm.links import LINKS_PER_TASK, stars
from loomwright.plans.joins import salted_join
from loomwright.session import gathered, stored

CELL_BITS = 18
SIGNATURE_LONGS = 32
CENTRES = 8
BROADCAST_ROWS = 1 << 20
# long signatures, or pairs that may have one, and grams of whole sets that a task gets where their number is known
SIGNED, GRAMS = 2_000, 250_000
# classes that are looked at to find very common grams, and how many of them share such a gram
SAMPLED, COMMON = 4096, 40
FACTORS = tuple(np.uint64(f) for f in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3))


def gram_hashes(hashes: np.ndarray, bounds: np.ndarray, size: int, ranks: np.ndarray) -> Iterator[np.ndarray]:
    """The n-gram set of each text in the global order.

    A gram is a 64-bit number: in front a rank of how common its words are (so that rare grams come first), behind it
    56 bits of hash. A text of fewer words than ``size`` has one gram, its whole sequence.
    """
    rank = ranks[(hashes >> np.uint64(64 - CELL_BITS)).astype(np.int64)]
    for first, end in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        own, common = hashes[first:end], rank[first:end]
        width = min(size, len(own))
        if not width:
            yield np.zeros(0, np.uint64)
            continue
        count = len(own) - width + 1
        code = np.full(count, np.uint64(width), np.uint64)
        sort = np.zeros(count, np.uint64)
        for k in range(width):
            code = mixed(code * FACTORS[1] + own[k: k + count] * FACTORS[0])
            sort += common[k: k + count]
        yield np.unique((np.minimum(sort, np.uint64(255)) << np.uint64(56)) | (code >> np.uint64(8)))


def signature(grams: np.ndarray) -> np.ndarray:
    """A bit set of parities: sets that differ in d grams differ in at most d bits.

    It has a power of two of bits, at least two for each gram, so that long sets are told apart as well as short ones.
    """
    width = 64 * SIGNATURE_LONGS
    while width < 2 * len(grams):
        width *= 2
    bits = np.bincount((mixed(grams) & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.uint64)


def folded(bits: np.ndarray, longs: int = SIGNATURE_LONGS) -> np.ndarray:
    """The signature of the same set with fewer bits."""
    return np.bitwise_xor.reduce(bits.reshape(-1, longs), axis=0)


def unlike(one: bytes, other: bytes) -> int:
    """So many grams at least are in only one of the sets with these signatures."""
    x, y = np.frombuffer(one, np.uint64), np.frombuffer(other, np.uint64)
    longs = min(len(x), len(y))
    return int(np.bitwise_count(folded(x, longs) ^ folded(y, longs)).sum(dtype=np.int64))


def digest(grams: np.ndarray) -> bytes:
    return hashlib.blake2b(grams.tobytes(), digest_size=16).digest()


@dataclass(frozen=True)
class Threshold:
    """Jaccard similarity of at least ``percent`` hundredths, in whole numbers."""

    percent: int

    def prefix(self, size: int) -> int:
        """So many leading grams of two linked sets share one."""
        return size - -(-self.percent * size // 100) + 1 if size else 0

    def overlap(self, one: int, other: int) -> int:
        """The least number of common grams of linked sets of these sizes."""
        return -(-self.percent * (one + other) // (100 + self.percent))

    def linked(self, common: int, one: int, other: int) -> bool:
        return 100 * common >= self.percent * (one + other - common)

    def roomy(self, one: Column, one_place: Column, other: Column, other_place: Column) -> Column:
        """Sizes, and the places of a common gram in both ordered sets, leave room for a link."""
        least = F.ceil(self.percent * (one + other) / F.lit(float(100 + self.percent)) - 1e-9)
        most = F.least(one_place, other_place) + F.least(one - one_place, other - other_place)
        return (100 * F.least(one, other) >= self.percent * F.greatest(one, other)) & (most >= least)


class Node:
    """A token of the tree; what its subtree can still offer. A subtree of one set is not unfolded."""

    __slots__ = ("children", "group", "lone", "records", "room", "smallest")

    def __init__(self):
        self.children: dict[int, Node] | None = None
        self.records: list[int] | None = None  # sets that end here
        self.lone: int | None = None  # the only set that goes on below, not unfolded
        self.group = None  # the only component below, or MIXED
        self.room = 0  # most grams that a set below has left
        self.smallest = 1 << 62  # least size of a set below


MIXED = object()


@dataclass
class Record:
    node: int
    component: int
    size: int
    tokens: list[int]  # grams of the prefix that other sets have too, in global order, from the tree's own gram on
    places: list[int]  # their places in the set
    bits: np.ndarray


class PrefixTree:
    """The sets that share one gram, as a tree over their ordered shared grams."""

    def __init__(self, records: list[Record], limit: Threshold):
        self.records, self.limit, self.root = records, limit, Node()
        for number in range(len(records)):
            self._add(self.root, number, 0)

    def _add(self, node: Node, number: int, depth: int) -> None:
        record = self.records[number]
        while True:
            empty = node.group is None
            node.room = max(node.room, record.size - record.places[depth - 1] - 1 if depth else record.size)
            node.smallest = min(node.smallest, record.size)
            node.group = record.component if empty or node.group == record.component else MIXED
            if depth == len(record.tokens):
                if node.records is None:
                    node.records = []
                node.records.append(number)
                return
            if empty:
                node.lone = number
                return
            if node.children is None:
                node.children = {}
            if node.lone is not None:  # a second set: the first one moves a token further
                first, node.lone = node.lone, None
                self._add(node.children.setdefault(self.records[first].tokens[depth], Node()), first, depth + 1)
            token = record.tokens[depth]
            if token not in node.children:
                node.children[token] = Node()
            node, depth = node.children[token], depth + 1

    def partners(self, number: int) -> list[int]:
        """Sets of other components that may be linked with this set, if the tree's gram is the first that both share, and
        those alone in a subtree, which share that gram at least.

        Walks the tree once: what two sets share on a common path is counted once for all sets below. A subtree is left
        when all its sets are of the same component as this set, or when the grams shared so far and those left on either
        side can't reach the needed overlap. Pairs that share an earlier gram too are found in that gram's tree.
        """
        own, limit = self.records[number], self.limit
        tokens, places, size = own.tokens, own.places, own.size
        out, stack = [], [(self.root, 0, 0, size)]
        while stack:
            node, at, shared, left = stack.pop()
            if node.lone is not None and self.records[node.lone].component != own.component:
                out.append(node.lone)
            if shared and node.records:
                out += [k for k in node.records if self.records[k].component != own.component]
            for token, child in (node.children or {}).items():
                if child.group == own.component:
                    continue
                place, rest = at, left
                while place < len(tokens) and tokens[place] < token:
                    rest = size - places[place] - 1
                    place += 1
                same = shared
                if place == len(tokens):  # behind this set's prefix nothing more is known of it
                    stack.append((child, place, same, rest))
                    continue
                if tokens[place] == token:
                    same, rest, place = shared + 1, size - places[place] - 1, place + 1
                if same + min(rest, child.room) >= limit.overlap(size, child.smallest):
                    stack.append((child, place, same, rest))
        return out


def least_of_each(groups: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each group has its least value, and whether it has others."""
    order = np.lexsort((values, groups))
    starts = np.flatnonzero(np.r_[True, np.diff(groups[order]) != 0])
    return order[starts], np.diff(np.r_[starts, len(order)]) > 1


def tree_pairs(records: list[Record], limit: Threshold, sides: list[int] | None = None, every: bool = True) -> list[tuple[int, int, bool]]:
    """Candidate pairs of different components. Only the sets outside the largest component search the tree.

    Without ``every`` a set is paired with the likest candidate of each other component only; the third value tells
    whether that component has more candidates, which were left out.
    """
    tree = PrefixTree(records, limit)
    count: dict[int, int] = {}
    for r in records:
        count[r.component] = count.get(r.component, 0) + 1
    largest = max(sorted(count), key=count.__getitem__)
    bits = np.stack([r.bits for r in records])
    sizes = np.array([r.size for r in records])
    groups = np.array([r.component for r in records])
    out = []
    for k, record in enumerate(records):
        if record.component == largest:
            continue
        found = np.array([j for j in tree.partners(k) if records[j].component == largest or j > k], np.int64)
        if sides is not None and len(found):  # pairs within one block are found in that block's own cell
            found = found[np.array([sides[j] != sides[k] for j in found])]
        if not len(found):
            continue
        unlike = np.bitwise_count(bits[found] ^ record.bits).sum(1, dtype=np.int64)
        total = sizes[found] + record.size
        least = -(-limit.percent * total // (100 + limit.percent))
        near = (unlike <= total - 2 * least) & (100 * np.minimum(sizes[found], record.size) >= limit.percent * np.maximum(sizes[found], record.size))
        found = found[near]
        if every or not len(found):
            out += [(k, j, False) for j in found.tolist()]
            continue
        likest, more = least_of_each(groups[found], unlike[near])
        out += [(k, j, others) for j, others in zip(found[likest].tolist(), more.tolist(), strict=True)]
    return out


@dataclass(frozen=True)
class NgramJoin:
    """Groups of texts linked by the Jaccard similarity of their sets of word n-grams.

    Words are runs of anything but ASCII white space, A-Z lower-cased; a set has the distinct grams of ``size`` words
    of the whole text, or the whole sequence if it has fewer words. Two texts link if their sets' Jaccard similarity
    is at least ``percent`` hundredths; a component is all that links reach. Every link between different sets is
    honoured, though not every one is listed.

    1. Texts with the same set are one class (16-byte digest of the set, then a number), so copies cost nothing further.
    2. Sets are ordered rarest gram first, by word counts over all texts in a fixed number of cells. Linked sets share
       a gram among their first ones. These grams are dealt out once and sorted, and stream past: only those of at least
       two classes are kept, and of grams with the same classes only the first. Grams that a sample of classes shows to
       be very common are shared in any case and need not be dealt out.
    3. Each gram names one of its classes as its centre, by one of ``CENTRES`` random orders of all classes; pairs with
       the centre are verified, the likest one of each class first and then those still apart. A large group of near copies becomes
       one component here, without its pairs.
    4. Grams whose classes are in more than one component build prefix trees, in blocks of ``block`` sets, so a common
       gram is spread over many tasks. A tree gets the grams from its own on; the candidates that trees, sizes
       and signatures leave are verified: of each set the likest one in each other component first, then, by the trees
       of the grams where such a pair is still apart, all others. So a large group has no pair for each two members.

    Verification compares whole sets. Sets are told apart by 56-bit hashes of grams.

    A NULL or empty text, or one without words, has an empty set and links with nothing. Rows are kept as they are,
    repeated ones too; rows with the same set are in the same component. NULL ids are never a component's id unless it
    has no other. Other columns play no part.
    """

    size: int = 3
    percent: int = 90
    block: int = 2000
    text: str = "text"
    key: str = "doc_id"

    def __call__(self, docs: DataFrame) -> DataFrame:
        """key, n_shingles and component_id of every row."""
        return self._joined(docs, docs.select(self.key))[0]

    def kept(self, docs: DataFrame) -> DataFrame:
        """The rows whose id is their component's, so one document of each component, with all their columns.

        What goes is told by row: another text of the same id stays where it belongs to another component. Repeated rows
        of the document that stays, rows without id and rows without words stay. A table may have any other columns.
        """
        number = "_row"
        while number in docs.columns:
            number += "_"
        marked = stored(docs.withColumn(number, F.monotonically_increasing_id()), "numbered")
        _, found = self._joined(marked.select(F.col(number).alias("_row"), F.col(self.key).alias("_key"), F.col(self.text).alias("_text")), None)
        goes = found.where("n_shingles > 0 and key != component_id").select(F.col("row").alias(number))
        return marked.join(goes, number, "left_anti").select(*docs.columns)

    def _joined(self, docs: DataFrame, named: DataFrame | None) -> tuple[DataFrame | None, DataFrame]:
        """The result by key, and row, key, n_shingles and the number of the component of every row."""
        spark, limit = docs.sparkSession, Threshold(self.percent)
        if named is not None:
            docs = docs.select(F.lit(0).cast("long").alias("_row"), F.col(self.key).alias("_key"), F.col(self.text).alias("_text"))
        ranks = spark.sparkContext.broadcast(self.ranks(docs))
        rows = self._rows(docs, ranks, limit)
        classes = stored(
            rows.where("node is not null").groupBy("node").agg(
                F.min("key").alias("least"), F.count("*").alias("copies"), F.min("place").alias("place"),
                F.first(F.struct("size", "prefix", "bits", "long_bits")).alias("set")).select(
                    F.monotonically_increasing_id().alias("id"), "node", "least", "copies", "place", "set.*"), "classes")
        records = self._records(classes)
        # the likest pair of each class first: whole sets travel again only for pairs that these have not joined
        pairs = stored(self._possible(self._star_pairs(records, classes, limit), classes, limit), "star-pairs")
        sets, many = self._whole_sets(docs, ranks, classes, pairs), pairs.count()
        once = pairs.groupBy("b").agg(F.min_by("a", F.struct("unlike", "a")).alias("a")).select("a", "b")
        once = stored(gathered(once, many, LINKS_PER_TASK), "gram-pairs")
        joined = stars(self._linked(once, sets, limit))
        rest = stored(gathered(self._apart(pairs.select("a", "b"), joined).join(once, ["a", "b"], "left_anti"), many, LINKS_PER_TASK), "gram-pairs")
        joined = self._joined_on(joined, self._linked(rest, sets, limit))
        first = stored(self._tree_pairs(records, classes, joined, limit), "tree-pairs")
        once = first.select("a", "b").distinct()
        whole = self._joined_on(joined, self._verified(docs, ranks, limit, classes, self._possible_long(once, classes, limit, first.count())))
        # pairs were left out beside these; where the two are joined now, so are those
        unsettled = stored(self._apart(first.where("gram is not null"), whole), "unsettled-pairs")
        if unsettled.count():
            others = stored(self._tree_pairs(records, classes, whole, limit, unsettled), "tree-pairs")
            fresh = others.select("a", "b").distinct().join(once, ["a", "b"], "left_anti")
            whole = self._joined_on(whole, self._verified(docs, ranks, limit, classes, self._possible_long(fresh, classes, limit, others.count())))
        share = max(1000, classes.count() // 1000)  # lists of hot keys have 1,000 entries at most
        labelled = classes.select("id", "node", "least", "copies").join(whole.select(F.col("node").alias("id"), "component"), "id", "left")
        labelled = stored(labelled.withColumn("component", F.coalesce("component", "id")), "class-components")
        first = labelled.groupBy("component").agg(F.min("least").alias("component_id"))
        found = salted_join(labelled, first, ["component"], rows_per_task=share)
        # rows without words get keys of their own, so that they do not meet in one task
        held = rows.select("row", "key", F.col("size").alias("n_shingles"),
                           F.coalesce("node", F.xxhash64("place", "key").cast("string").cast("binary")).alias("node"))
        many = max(1000, rows.count() // 1000)
        out = salted_join(held, found.select("node", "component", "component_id"), ["node"],
                          counts=labelled.select("node", F.col("copies").alias("_n")), rows_per_task=many)
        if named is None:
            return None, out
        return out.select(F.col("key").alias(self.key), "n_shingles", F.when(F.col("n_shingles") == 0, F.col("key")).otherwise(
            F.col("component_id")).alias("component_id")), out

    def _rows(self, docs: DataFrame, ranks, limit: Threshold) -> DataFrame:
        def described(batch: pa.RecordBatch) -> dict:
            sizes, nodes, prefixes, bits, long_bits = [], [], [], [], []
            for grams in self._sets(batch.column(3), ranks.value):
                sizes.append(len(grams))
                nodes.append(digest(grams) if len(grams) else None)
                prefixes.append(grams[: limit.prefix(len(grams))].view(np.int64))
                whole = signature(grams)
                bits.append(folded(whole).tobytes())
                long_bits.append(whole.tobytes() if len(whole) > SIGNATURE_LONGS else None)
            return {"row": batch.column(0), "key": batch.column(1), "place": batch.column(2), "size": pa.array(sizes, pa.int64()),
                    "node": pa.array(nodes, pa.binary()), "prefix": pa.array(prefixes, pa.list_(pa.int64())), "bits": pa.array(bits, pa.binary()),
                    "long_bits": pa.array(long_bits, pa.binary())}

        kind = docs.schema["_key"].dataType.simpleString()
        texts = docs.select("_row", "_key", self._place(), F.col("_text").alias("words"))
        schema = f"row long, key {kind}, place binary, size long, node binary, prefix array<long>, bits binary, long_bits binary"
        return stored(batch_map(texts, schema, described), "gram-sets")

    @staticmethod
    def _place() -> Column:
        """What a text is fetched by again."""
        return F.unhex(F.md5(F.coalesce("_text", F.lit("")).cast("binary"))).alias("place")

    def _postings(self, classes: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Leading grams that several classes have: (id, size, place, gram) of each class, and (gram, members, one, two) of each
        gram, where ``one`` and ``two`` tell sets of classes apart."""
        postings = classes.select("id", F.col("size").cast("int").alias("size"), F.posexplode("prefix").alias("place", "gram"))
        step = max(1, classes.count() // SAMPLED)
        sample = classes.where(F.pmod(F.xxhash64("id"), F.lit(step)) == 0).select(F.explode("prefix").alias("gram"))
        common = sample.groupBy("gram").count().where(F.col("count") >= COMMON).select("gram")
        # at most the sampled grams / COMMON
        common = stored(common, "common-grams")
        cold = postings.join(F.broadcast(common), "gram", "left_anti").select("gram", "id", "size", "place")
        dealt = small_batches(cold.repartition("gram").sortWithinPartitions("gram", "id"))

        def mixed_ids(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            return mixed(ids.view(np.uint64) * FACTORS[0] + FACTORS[1]), mixed(ids.view(np.uint64) * FACTORS[2] + FACTORS[3])

        def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            # of the gram that goes on in the next batch: its postings if it is the first one only, and its sums
            now, lone, members, one, two = None, None, 0, np.uint64(0), np.uint64(0)

            def sent(gram, ids, size, place, count, one, two) -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([
                    pa.array(gram, pa.int64()), pa.array(ids, pa.int64()), pa.array(size, pa.int32()), pa.array(place, pa.int32()),
                    pa.array(count, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64())],
                    names=["gram", "id", "size", "place", "members", "one", "two"])

            for batch in batches:
                gram, ids, size, place = (batch.column(k).to_numpy() for k in range(4))
                if not len(gram):
                    continue
                starts = np.flatnonzero(np.r_[True, gram[1:] != gram[:-1]])
                counts = np.diff(np.r_[starts, len(gram)])
                a, b = mixed_ids(ids)
                ones, twos = np.bitwise_xor.reduceat(a, starts), np.bitwise_xor.reduceat(b, starts)
                going_on = now is not None and gram[0] == now
                if going_on:
                    counts[0] += members
                    ones[0] ^= one
                    twos[0] ^= two
                keep = np.repeat(counts > 1, np.diff(np.r_[starts, len(gram)]))
                first = lone if going_on and members == 1 else None
                ended = counts[:-1] > 1  # the last gram may go on
                done = [gram[starts[:-1]][ended], counts[:-1][ended], ones[:-1][ended], twos[:-1][ended]]
                if now is not None and not going_on and members > 1:
                    done = [np.r_[np.array([v], d.dtype), d] for v, d in zip((now, members, one, two), done)]
                if first is not None:
                    yield sent(*[[int(v)] for v in first], [None], [None], [None])
                zero = [None] * int(keep.sum())
                if zero:
                    yield sent(gram[keep], ids[keep], size[keep], place[keep], zero, zero, zero)
                if len(done[0]):
                    blank = [None] * len(done[0])
                    yield sent(done[0], blank, blank, blank, done[1], done[2].view(np.int64), done[3].view(np.int64))
                now, members, one, two = gram[-1], int(counts[-1]), ones[-1], twos[-1]
                lone = (gram[-1], ids[-1], size[-1], place[-1]) if members == 1 else None
            if members > 1:
                yield sent([now], [None], [None], [None], [members], [one.view(np.int64)], [two.view(np.int64)])
            give_back()

        found = stored(dealt.mapInArrow(shared, "gram long, id long, size int, place int, members long, one long, two long"), "shared-grams")
        # common grams are counted before they are shuffled
        hot = postings.join(F.broadcast(common), "gram", "left_semi")
        totals = hot.groupBy("gram").agg(F.count("*").alias("members"), F.bit_xor(F.xxhash64("id")).alias("one"),
                                         F.bit_xor(F.xxhash64(F.lit("two"), "id")).alias("two"))
        kept = found.where("id is not null").select("id", "size", "place", "gram").unionByName(hot.select("id", "size", "place", "gram"))
        return kept, found.where("id is null").select("gram", "members", "one", "two").unionByName(totals)

    def _records(self, classes: DataFrame) -> DataFrame:
        """Classes that share a leading gram with others: their shared grams in order, those kept for joining marked."""
        postings, grams = self._postings(classes)
        grams = stored(grams.where("members > 1"), "gram-counts")
        # grams rise with their rank as unsigned numbers; ranks stay below 256, so shift the sign away to compare
        order = F.expr("gram ^ -9223372036854775808")
        first = grams.groupBy("members", "one", "two").agg(F.min_by("gram", order).alias("gram")).select("gram", F.lit(True).alias("joins"))
        marked = grams.select("gram", "members").join(first, "gram", "left").select("gram", "members", F.coalesce("joins", F.lit(False)).alias("joins"))
        share = max(100_000, classes.count() // 100)  # at most 100 grams times the length of a prefix are cut into slices
        held = salted_join(postings, marked, ["gram"], "inner", counts=marked.select("gram", F.col("members").alias("_n")), rows_per_task=share)
        return stored(held.groupBy("id", "size").agg(
            F.array_sort(F.collect_list(F.struct("place", "gram", "joins", "members"))).alias("shared")), "gram-records")

    def _members(self, records: DataFrame) -> DataFrame:
        return records.select("id", "size", F.explode(F.filter("shared", lambda s: s["joins"])).alias("s")).select(
            "id", "size", F.col("s.gram").alias("gram"), F.col("s.place").alias("place"), F.col("s.members").alias("members"))

    def _star_pairs(self, records: DataFrame, classes: DataFrame, limit: Threshold) -> DataFrame:
        members = self._members(records)
        # grams with almost the same classes mostly agree on a centre, but not all on one, so that pairs are few and spread
        order = F.xxhash64(F.pmod("gram", F.lit(CENTRES)), F.col("id"))
        centres = members.groupBy("gram").agg(F.min(F.struct(order.alias("h"), "id", "size", "place")).alias("c"), F.count("*").alias("_n"))
        counts = centres.select("gram", "_n")
        centres = centres.select("gram", F.col("c.id").alias("centre"), F.col("c.size").alias("centre_size"), F.col("c.place").alias("centre_place"))
        share = max(100_000, classes.count() // 100)
        pairs = (salted_join(members.select("gram", "id", "size", "place"), centres, ["gram"], "inner", counts=counts, rows_per_task=share)
                 .where("id != centre")
                 .where(limit.roomy(F.col("size"), F.col("place"), F.col("centre_size"), F.col("centre_place")))
                 .select(F.least("id", "centre").alias("a"), F.greatest("id", "centre").alias("b")).distinct())
        return pairs

    @staticmethod
    def _joined_on(joined: DataFrame, links: DataFrame) -> DataFrame:
        """The components after further links."""
        return stars(joined.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(links))

    @staticmethod
    def _apart(pairs: DataFrame, joined: DataFrame) -> DataFrame:
        """The pairs that are not in one component."""
        one = joined.select(F.col("node").alias("a"), F.col("component").alias("a_component"))
        two = joined.select(F.col("node").alias("b"), F.col("component").alias("b_component"))
        return pairs.join(one, "a", "left").join(two, "b", "left").where(
            F.coalesce("a_component", "a") != F.coalesce("b_component", "b")).select(*pairs.columns)

    def _possible(self, pairs: DataFrame, classes: DataFrame, limit: Threshold) -> DataFrame:
        """Pairs (a, b) that sizes and signatures leave room for, and in how many grams at least they differ (``unlike``)."""
        one, two = (classes.select(F.col("id").alias(side), F.col("size").alias(f"{side}_size"), F.col("bits").alias(f"{side}_bits"),
                                   F.col("long_bits").alias(f"{side}_long")) for side in "ab")

        def checked(batch: pa.RecordBatch) -> pa.RecordBatch:
            a_bits, b_bits = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint64).reshape(-1, SIGNATURE_LONGS) for k in ("a_bits", "b_bits"))
            x, y = batch.column("a_size").to_numpy(), batch.column("b_size").to_numpy()
            apart = np.bitwise_count(a_bits ^ b_bits).sum(1, dtype=np.int64)
            a_long, b_long = batch.column("a_long"), batch.column("b_long")
            for k in np.flatnonzero(a_long.is_valid().to_numpy(False) & b_long.is_valid().to_numpy(False)).tolist():
                apart[k] = unlike(a_long[k].as_buffer(), b_long[k].as_buffer())
            least = -(-limit.percent * (x + y) // (100 + limit.percent))
            near = (apart <= x + y - 2 * least) & (100 * np.minimum(x, y) >= limit.percent * np.maximum(x, y))
            return batch.select(["a", "b"]).append_column("unlike", pa.array(apart)).filter(pa.array(near))

        both = pairs.join(one, "a").join(two, "b").select("a", "b", "a_size", "b_size", "a_bits", "b_bits", "a_long", "b_long")
        return batch_map(both, "a long, b long, unlike long", checked)

    @staticmethod
    def _possible_long(pairs: DataFrame, classes: DataFrame, limit: Threshold, rows: int) -> DataFrame:
        """Pairs (a, b), at most ``rows`` of them, that the long signatures of long sets leave room for; the others as they are."""
        held = classes.where("long_bits is not null").select("id", "size", "long_bits")
        rows = max(rows, held.count())  # all of them take part in the join
        one, two = (held.select(F.col("id").alias(side), F.col("size").alias(f"{side}_size"), F.col("long_bits").alias(f"{side}_bits")) for side in "ab")

        def checked(batch: pa.RecordBatch) -> pa.RecordBatch:
            near = []
            for x, y, *bits in zip(*(batch.column(k).to_pylist() for k in ("a_size", "b_size")), batch.column("a_bits"), batch.column("b_bits"), strict=True):
                if x is None or y is None:
                    near.append(True)
                    continue
                near.append(unlike(*(b.as_buffer() for b in bits)) <= x + y - 2 * limit.overlap(x, y))
            return batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

        both = pairs.join(one, "a", "left").join(two, "b", "left")
        return batch_map(gathered(both.select("a", "b", "a_size", "b_size", "a_bits", "b_bits"), rows, SIGNED), "a long, b long", checked)

    def _tree_pairs(self, records: DataFrame, classes: DataFrame, joined: DataFrame, limit: Threshold, unsettled: DataFrame | None = None) -> DataFrame:
        """Candidate pairs (a, b) across components, from the prefix trees of grams whose classes are not all joined.

        Each tree gives the likest candidate of each set in each other component; ``gram`` is the tree's if that component
        has more candidates there, else NULL. With ``unsettled`` pairs of that kind only their grams have trees, of the
        sets in the pairs' components, which give all candidates.
        """
        block, every = self.block, unsettled is not None
        if every:
            holders = records.select("id", F.explode("shared.gram").alias("gram")).join(
                unsettled.select("gram").distinct(), "gram", "left_semi").select("id").distinct()
            records = records.join(holders, "id", "left_semi")
        named = records.select("id", "size", "shared").join(joined.select(F.col("node").alias("id"), "component"), "id", "left")
        labelled = stored(named.withColumn("component", F.coalesce("component", "id")), "labelled-records")
        members = labelled.select("id", "component", F.explode(F.filter("shared", lambda s: s["joins"] & (s["members"] > 2))).alias("s")).select(
            "id", "component", F.col("s.gram").alias("gram"), F.col("s.place").alias("place"),
            F.ceil(F.col("s.members") / F.lit(block)).cast("int").alias("blocks"))
        if every:
            ends = unsettled.select("gram", F.explode(F.array("a", "b")).alias("id")).join(labelled.select("id", "component"), "id")
            members = members.join(ends.select("gram", "component").distinct(), ["gram", "component"], "left_semi")
        spread = members.groupBy("gram").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low != high")
        # whole records follow only for the grams that are left, and of them what stands from the gram on
        bits = classes.select("id", "bits")
        rows = members.join(spread.select("gram"), "gram", "left_semi").select("id", "gram", "place", "blocks").join(
            labelled.select("id", "component", "size", "shared"), "id").join(bits, "id")
        rest = F.filter("shared", lambda s: s["place"] >= F.col("place"))
        rows = rows.select("gram", "blocks", "id", "component", "size", "bits", F.transform(rest, lambda s: s["gram"]).alias("grams"),
                           F.transform(rest, lambda s: s["place"]).alias("places"))
        rows = rows.withColumn("side", F.pmod(F.xxhash64("id", F.lit("block")), F.col("blocks")).cast("int"))
        rows = rows.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
        rows = rows.select("gram", F.least("side", "other").alias("low"), F.greatest("side", "other").alias("high"), "side",
                           "id", "component", "size", "bits", "grams", "places")
        cells = rows.repartition("gram", "low", "high").sortWithinPartitions("gram", "low", "high")

        def joined_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cell, held, sides = None, [], []
            for batch in batches:
                *columns, bits, grams, places = (batch.column(k) for k in range(batch.num_columns))
                signatures = np.frombuffer(b"".join(bits.to_pylist()), np.uint64).reshape(-1, SIGNATURE_LONGS)
                ends = grams.value_lengths().to_numpy().cumsum()
                tokens, at = grams.flatten().to_numpy().view(np.uint64), places.flatten().to_numpy()
                out: list[tuple[int, int, int | None]] = []
                for row, (gram, low, high, side, node, component, size) in enumerate(zip(*(c.to_pylist() for c in columns), strict=True)):
                    if (gram, low, high) != cell:
                        out += pairs_of(cell, held, sides)
                        cell, held, sides = (gram, low, high), [], []
                    own = slice(ends[row - 1] if row else 0, ends[row])
                    held.append(Record(node, component, size, tokens[own].tolist(), at[own].tolist(), signatures[row]))
                    sides.append(side)
                yield sent(out)
            yield sent(pairs_of(cell, held, sides))
            give_back()

        def pairs_of(cell: tuple | None, held: list[Record], sides: list[int]) -> list[tuple[int, int, int | None]]:
            if cell is None or len({r.component for r in held}) < 2:
                return []
            found = tree_pairs(held, limit, sides if cell[1] != cell[2] else None, every)
            return [(held[k].node, held[j].node, cell[0] if more else None) for k, j, more in found]

        def sent(pairs: list[tuple[int, int, int | None]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"a": pa.array([min(p[:2]) for p in pairs], pa.int64()), "b": pa.array([max(p[:2]) for p in pairs], pa.int64()),
                                               "gram": pa.array([p[2] for p in pairs], pa.int64())})

        return small_batches(cells).mapInArrow(joined_cells, "a long, b long, gram long")

    def _verified(self, docs: DataFrame, ranks, limit: Threshold, classes: DataFrame, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose whole sets are similar enough."""
        pairs = stored(pairs, "gram-pairs")
        return self._linked(pairs, self._whole_sets(docs, ranks, classes, pairs), limit)

    def _whole_sets(self, docs: DataFrame, ranks, classes: DataFrame, pairs: DataFrame) -> DataFrame:
        """(id, size, grams) of the classes in these pairs, from the texts."""
        needed = stored(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct().join(classes.select("id", "size", "place"), "id"), "needed-sets")
        # a class has one text to be fetched by, and texts of one digest are one text
        many, grams = needed.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
        named = needed.select("id", "place")
        wanted = F.broadcast(named) if many <= BROADCAST_ROWS else named  # at most BROADCAST_ROWS digests
        texts = (docs.select(self._place(), F.col("_text").alias("words")).join(wanted, "place")
                 .groupBy("id").agg(F.first("words").alias("words")))

        def sets(batch: pa.RecordBatch) -> dict:
            found = [*self._sets(batch.column(1), ranks.value)]
            return {"id": batch.column(0), "size": pa.array([len(g) for g in found], pa.int64()), "grams": pa.array([g.tobytes() for g in found], pa.binary())}

        return stored(batch_map(gathered(texts, grams, GRAMS), "id long, size long, grams binary", sets), "whole-sets")

    @staticmethod
    def _linked(pairs: DataFrame, sets: DataFrame, limit: Threshold) -> DataFrame:
        """The pairs (a, b) whose whole sets, among ``sets``, are similar enough."""
        # all sets take part in the join, and each pair carries some
        many, grams = sets.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
        grams = grams * max(many, pairs.count()) // max(1, many)
        one, two = (sets.select(F.col("id").alias(side), F.col("grams").alias(f"{side}_grams")) for side in "ab")
        both = pairs.join(one, "a").join(two, "b").select("a", "b", "a_grams", "b_grams")

        def checked(batch: pa.RecordBatch) -> pa.RecordBatch:
            linked = []
            for one, other in zip(batch.column("a_grams"), batch.column("b_grams"), strict=True):
                x, y = np.frombuffer(one.as_buffer(), np.uint64), np.frombuffer(other.as_buffer(), np.uint64)
                linked.append(limit.linked(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y)))
            return batch.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))

        return stored(batch_map(gathered(both, grams, GRAMS), "a long, b long", checked), "gram-links")

    def ranks(self, docs: DataFrame) -> np.ndarray:
        """How common the words of each hash cell are, on a scale of logarithms."""
        def count(batch: pa.RecordBatch, sums: np.ndarray) -> None:
            for _, _, data, bounds in text_slices(batch.column(0)):
                hashes, _ = words(data, bounds, SPACED)
                sums[: 1 << CELL_BITS] += np.bincount((hashes >> np.uint64(64 - CELL_BITS)).astype(np.int64), minlength=1 << CELL_BITS)

        counts = summed(docs.select("_text"), 1 << CELL_BITS, count)
        return np.minimum(np.round(2 * np.log2(counts + 1)), 255 // self.size).astype(np.uint64)

    def _sets(self, batch_column: pa.Array, ranks: np.ndarray) -> Iterator[np.ndarray]:
        for _, _, data, bounds in text_slices(batch_column):
            hashes, at = words(data, bounds, SPACED)
            yield from gram_hashes(hashes, at, self.size, ranks)
