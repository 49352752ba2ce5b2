"""Exact n-gram Jaccard join by set relations: block-skip index lists and answers derived from similar sets.

Documents become sets of word n-grams; equal sets are one set with many documents.  The method:

1. *Sets.* One pass over the texts hashes the n-grams and deals the tokens out by hash range; in each range the tokens
   that two or more different sets hold get their frequency.  Sets are ordered rare tokens first, so a set with more
   unshared tokens than the threshold leaves room for (most sets) has no partner and goes no further.
2. *Index.* The tokens in a set's prefix are posted to lists; a list is cut into blocks by set size and by position.  Two
   blocks whose best case falls short of the overlap wanted are skipped as a whole (length and positional bounds).
3. *Answers.* In each block the set most of whose tokens are shared leads, and members are held against leaders, which is
   linear in the list.  A leader's answer for a member is the difference of the two sets: tokens gone and tokens extra.
   Every member takes the similar leader with the most members as its home, and what follows is derived from the homes'
   answers: two members of a home have the leader's size less what either lacks plus what they lack or add alike in common,
   so only differences are compared, in blocks of members; blocks whose differences are too small or too large to matter
   are answered as a whole.  A member and a set of another home have the leader's overlap with that set, corrected by the
   member's difference.  Pairs across homes come from the lists; Jaccard distance is a metric, so those whose distances to
   a leader differ by more than the threshold allows are left out.  No link is lost, and no group is expanded into its pairs.

Defined results: null, empty and blank texts have empty sets (size 0) and link with nothing; texts under n words have one
token, the whole sequence; rows with a null id get a size and no component and link with nothing; repeated rows are
documents of their own with the same set; columns other than id and text are ignored.  n_links counts the other documents
that a document is linked with, copies among them, each once.  Tokens and sets are told apart by 64-bit hashes.

Bounds: a task holds the signatures of the different sets of its own split, and the tokens of one hash range, of which
there is one for each `RANGE_BYTES` of text at least; blocks of members have `BLOCK_SETS` sets or thrice that at most.  A
list whose sets are of many homes and unlike each other costs the pairs that the bounds leave.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideline.llm.components import connected_components
from tideline.llm.scan import NOT_SPACE, U, grams, mix, run_hash, scan
from tideline.llm.scratch import Scratch, shuffle_partitions

_ROWS = "shard int, id long, th long, n int, sig long, runs binary, tokens binary"
_NAMES = [x.split()[0] for x in _ROWS.split(", ")]
_RUN = np.dtype([("sig", np.int64), ("n", np.int32), ("k", np.int32)])
#: Tokens that a task gathers before it sends them on.
FLUSH = 1 << 19
#: Parts of a hash range that a task counts one after the other.
SUBRANGES = 8
#: Bytes of text for each hash range, at most.
RANGE_BYTES = 64 << 20
#: Sets of a home that are compared at once, and tokens of a matrix of them.
BLOCK_SETS, BLOCK_TOKENS = 512, 4096


@dataclass
class NgramJoin:
    """documents: (id, text_hash, n_tokens, sig, group, component, n_links), group being one number for all of a component; links: pairs of sets (a, b) that join all of a component;
    sets: (sig, representative id, copies)."""

    documents: DataFrame
    links: DataFrame
    sets: DataFrame


def _dealt(n: int, shards: int):
    """Documents (id, text hash, text) to a row each and, for every new set of a task, its tokens packed by hash range."""
    shift = 64 - max(1, (shards - 1).bit_length())

    def rows(batches):
        seen: set[int] = set()
        sigs: list[int] = []
        sets: list[np.ndarray] = []
        held = 0

        def flush():
            tok = np.concatenate(sets)
            run = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
            at = (tok >> U(shift)).astype(np.int64) % shards
            order = np.argsort(at, kind="stable")
            tok, run, at = tok[order], run[order], at[order]
            cuts = np.flatnonzero(np.diff(at)) + 1
            sig, size = np.array(sigs, np.int64), np.array([len(s) for s in sets], np.int32)
            out: dict[str, list] = {k: [] for k in ("shard", "runs", "tokens")}
            for a, b in zip(np.r_[0, cuts], np.r_[cuts, len(tok)]):
                r, k = np.unique(run[a:b], return_counts=True)
                packed = np.empty(len(r), _RUN)
                packed["sig"], packed["n"], packed["k"] = sig[r], size[r], k
                out["shard"].append(int(at[a]))
                out["runs"].append(packed.tobytes())
                out["tokens"].append(tok[a:b].tobytes())
            nothing = [None] * len(out["shard"])
            return pa.record_batch(
                [pa.array(out["shard"], pa.int32()), pa.array(nothing, pa.int64()), pa.array(nothing, pa.int64()), pa.array(nothing, pa.int32()), pa.array(nothing, pa.int64()), pa.array(out["runs"], pa.binary()), pa.array(out["tokens"], pa.binary())],
                _NAMES,
            )

        for batch in batches:
            ids, m = batch.column(0), batch.num_rows
            known = np.asarray(ids.is_valid())
            sizes, sig_of = np.zeros(m, np.int32), np.zeros(m, np.int64)
            for i, w in scan(batch.column(2), NOT_SPACE):
                g, first = grams(w.hashes, n), w.first.tolist()
                for j in range(len(first) - 1):
                    a, b = first[j], first[j + 1]
                    if a == b:
                        continue
                    s = np.unique(g[a : b - n + 1]) if b - a >= n else np.array([run_hash(w.hashes[a:b])], np.uint64)
                    sig = int(mix(np.array([s.sum() + U(len(s))], np.uint64))[0].astype(np.int64))
                    sizes[i + j], sig_of[i + j] = len(s), sig
                    if known[i + j] and sig not in seen:
                        seen.add(sig)
                        sigs.append(sig)
                        sets.append(s)
                        held += len(s)
                        if held >= FLUSH:
                            yield flush()
                            sigs, sets, held = [], [], 0
            nothing = pa.nulls(m, pa.binary())
            yield pa.record_batch(
                [pa.array(np.abs(sig_of % shards).astype(np.int32)), ids.cast(pa.int64()), batch.column(1), pa.array(sizes), pa.array(sig_of, mask=(sizes == 0) | ~known), nothing, nothing],
                _NAMES,
            )
        if sets:
            yield flush()

    return rows


def _shared(batches):
    """Of the tokens of one hash range, those of two or more sets, with their frequency; document rows pass through."""
    names = ["kind", "id", "th", "n", "sig", "token", "df"]
    runs, toks = [], []
    for batch in batches:
        doc = batch.filter(batch.column("tokens").is_null())
        if doc.num_rows:
            m = doc.num_rows
            yield pa.record_batch([pa.array(np.zeros(m, np.int32)), doc.column("id"), doc.column("th"), doc.column("n"), doc.column("sig"), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int32())], names)
        for r, t in zip(batch.column("runs"), batch.column("tokens")):
            if t.is_valid:
                runs.append(np.frombuffer(r.as_buffer(), _RUN))
                toks.append(np.frombuffer(t.as_buffer(), np.uint64))
    if not toks:
        return
    run, tok = np.concatenate(runs), np.concatenate(toks)
    del runs, toks
    at = np.repeat(np.arange(len(run), dtype=np.int32), run["k"])
    part = (tok & U(SUBRANGES - 1)).astype(np.uint8)
    for k in range(SUBRANGES):
        yield from _frequent(run, tok[part == k], at[part == k], names)


def _frequent(run: np.ndarray, tok: np.ndarray, at: np.ndarray, names: list[str]):
    """Rows of the tokens that two or more sets have; a set that several tasks have sent counts once."""
    order = np.argsort(tok)
    tok, at = tok[order], at[order]
    new = np.r_[True, tok[1:] != tok[:-1]][: len(tok)]
    alone = new & np.r_[new[1:], True][: len(tok)]
    tok, at = tok[~alone], at[~alone]
    if not len(tok):
        return
    sig = run["sig"][at]
    order = np.lexsort((sig, tok))
    tok, sig, at = tok[order], sig[order], at[order]
    new = np.r_[True, (tok[1:] != tok[:-1]) | (sig[1:] != sig[:-1])]
    tok, sig, at = tok[new], sig[new], at[new]
    edge = np.r_[0, np.flatnonzero(tok[1:] != tok[:-1]) + 1, len(tok)]
    df = np.repeat(np.diff(edge), np.diff(edge)).astype(np.int32)
    keep = np.flatnonzero(df > 1)
    for a in range(0, len(keep), 1 << 16):
        k = keep[a : a + (1 << 16)]
        m = len(k)
        yield pa.record_batch([pa.array(np.ones(m, np.int32)), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.array(run["n"][at[k]]), pa.array(sig[k]), pa.array(tok[k].view(np.int64)), pa.array(df[k])], names)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80) -> NgramJoin:
    """Documents whose n-gram sets are as similar as percent, as components with numbers of links. See the module."""
    scratch, text = Scratch(spark, "ngram-join"), F.col(f"`{text_col}`")
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    shards = max(shuffle_partitions(spark), -(-size // RANGE_BYTES))
    dealt = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.xxhash64(text).alias("th"), text.alias("text")).mapInArrow(_dealt(n, shards), _ROWS)
    stage = scratch.put(
        dealt.repartitionById(shards, F.col("shard")).mapInArrow(_shared, "kind int, id long, th long, n int, sig long, token long, df int"), by="kind"
    )
    documents = scratch.put(stage.filter("kind = 0").select("id", "th", "n", "sig"))
    sets = _sets(scratch, stage.filter("kind = 1").select("sig", "n", "token", "df"), percent)
    scratch.drop(stage)
    held = documents.filter("sig is not null").groupBy("sig").agg(F.min("id").alias("representative"), F.count("*").alias("copies"))
    links, degrees = _links(scratch, sets, held.select("sig", "copies"), percent)
    roots = connected_components(links, scratch)
    labelled = held.join(roots.withColumnRenamed("node", "sig"), "sig", "left").withColumn("root", F.coalesce("root", "sig"))
    least = labelled.groupBy("root").agg(F.min("representative").alias("component"))
    labelled = labelled.join(least, "root").join(degrees, "sig", "left")
    labelled = labelled.select("sig", F.col("root").alias("group"), "component", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = documents.join(labelled, "sig", "left").select(
        "id", F.col("th").alias("text_hash"), F.col("n").cast("long").alias("n_tokens"), "sig", "group", F.coalesce("component", "id").alias("component"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )
    return NgramJoin(out, links, held)


def _sets(scratch: Scratch, tokens: DataFrame, t: int) -> DataFrame:
    """(sig, n, many, tokens) of each set that can have a partner: how many tokens it shares, and those, rare first."""
    own = Window.partitionBy("sig").orderBy("df", "token")
    members = (
        tokens.withColumn("rank", F.row_number().over(own))
        .withColumn("many", F.count("*").over(own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        .filter(F.col("many") >= F.ceil(F.col("n") * t / 100))  # the overlap that any partner needs
    )
    return scratch.put(
        members.groupBy("sig", "n", "many").agg(F.sort_array(F.collect_list(F.struct("rank", "token"))).alias("held"))
        .select("sig", "n", "many", F.col("held.token").alias("tokens"))
    )


def _links(scratch: Scratch, sets: DataFrame, copies: DataFrame, t: int) -> tuple[DataFrame, DataFrame]:
    """(a, b) of similar sets, enough to join all of a component, and (sig, links): the documents of other sets that each
    set is similar to."""
    room = (F.col("n") - F.ceil(F.col("n") * t / 100) + 1 - (F.col("n") - F.col("many"))).cast("int")
    block = F.floor(F.log(F.col("n").cast("double")) / math.log(100 / t)).cast("int")
    postings = (
        sets.select("sig", "n", "many", block.alias("block"), F.posexplode(F.slice("tokens", 1, room)).alias("k", "token"))
        .select("token", "block", "sig", "n", (F.col("n") - F.col("many") + F.col("k")).alias("pos"), (F.col("many") / F.col("n")).alias("shared_part"))
    )
    lists = postings.groupBy("token").agg(F.count("*").alias("members")).filter("members > 1").select("token")
    postings = scratch.put(postings.join(lists, "token"))

    # Answers of the leaders: every posting against the leader of its own block and of the two beside it.
    leaders = postings.groupBy("token", "block").agg(F.max_by(F.struct("sig", "n", "pos"), F.struct("shared_part", "n", "sig")).alias("lead"))
    beside = F.explode(F.array(F.col("block") - 1, F.col("block"), F.col("block") + 1)).alias("at")
    led = (
        postings.select("token", "sig", "n", "pos", beside).join(leaders.withColumnRenamed("block", "at"), ["token", "at"])
        .filter(F.col("sig") != F.col("lead.sig"))
        .select("sig", F.col("lead.sig").alias("lead"), "n", F.col("lead.n").alias("other_n"), "pos", F.col("lead.pos").alias("other_pos"))
        .filter(_reach(t)).select("sig", "lead").distinct()
    )
    own = sets.select("sig", "n", "many", "tokens")
    gone = F.array_except("led", "tokens")
    answers = (
        led.join(own.toDF("lead", "ln", "lmany", "led"), "lead").join(own, "sig")
        .select("sig", "lead", "n", "ln", "lmany", "tokens", "led", gone.alias("gone"))
        .withColumn("shared", F.col("lmany") - F.size("gone")).withColumn("alike", _alike(t, "n", "ln"))
        .select("sig", "lead", "n", "ln", "lmany", "shared", "alike", F.when(F.col("alike"), F.col("gone")).alias("gone"), F.when(F.col("alike"), F.array_except("tokens", "led")).alias("extra"))
    )
    answers = scratch.put(answers)
    members = scratch.put(_homes(answers, postings.select("sig", "n").distinct(), copies))
    near = answers.filter("alike").select("sig", "lead")
    edges = near.select(F.least("sig", "lead").alias("a"), F.greatest("sig", "lead").alias("b"))

    # Links across homes: the leaders' answers, and pairs of the lists that these leave open.
    home = members.select("sig", "home", "followers")
    homes = near.join(home, "sig").join(home.toDF("lead", "lead_home", "_"), "lead").filter("home <> lead_home")
    known = homes.select(F.least("sig", "lead").alias("a"), F.greatest("sig", "lead").alias("b")).distinct()
    more = _across(scratch, postings, leaders, answers, members, sets, t)
    across = scratch.put(known.unionByName(more.filter("alike").select("a", "b")))
    edges = scratch.put(edges.unionByName(across).distinct())
    many = copies.withColumnRenamed("sig", "b").join(across, "b").select(F.col("a").alias("sig"), F.col("copies").alias("links"))
    many = many.unionByName(copies.withColumnRenamed("sig", "a").join(across, "a").select(F.col("b").alias("sig"), F.col("copies").alias("links")))
    degrees = scratch.put(many.unionByName(_within(scratch, members, t)).groupBy("sig").agg(F.sum("links").alias("links")))
    scratch.drop(sets, postings, answers, members)
    return edges, degrees


def _reach(t: int):
    """The length and positional bounds of a pair (n, pos) and (other_n, other_pos)."""
    best = 1 + F.least(F.col("n") - F.col("pos") - 1, F.col("other_n") - F.col("other_pos") - 1)
    return (100 * F.least("n", "other_n") >= t * F.greatest("n", "other_n")) & (best >= _wanted(t, F.col("n") + F.col("other_n")))


def _wanted(t: int, sizes):
    """The overlap that two similar sets of that many tokens together have at least."""
    return F.ceil(sizes * t / (100 + t))


def _alike(t: int, n: str, other: str):
    return 100 * F.col("shared") >= t * (F.col(n) + F.col(other) - F.col("shared"))


def _homes(answers: DataFrame, all_sets: DataFrame, copies: DataFrame) -> DataFrame:
    """(sig, n, copies, home, followers, lmany, gone, extra) of every set: of the similar leaders, itself among them if it
    leads, the one that most sets are similar to. A set without one is its own home."""
    similar = answers.filter("alike")
    followers = similar.groupBy("lead").agg(F.count("*").alias("followers"), F.max("lmany").alias("lmany"))
    choice = similar.join(followers.select("lead", "followers"), "lead").select("sig", "lead", "followers")
    choice = choice.unionByName(followers.select(F.col("lead").alias("sig"), "lead", "followers"))
    chosen = choice.groupBy("sig").agg(F.max(F.struct("followers", "lead")).alias("c")).select("sig", F.col("c.lead").alias("home"), "c.followers")
    diff = similar.select("sig", F.col("lead").alias("home"), "lmany", "gone", "extra")
    nothing = F.array().cast("array<long>")
    return (
        all_sets.join(copies, "sig").join(chosen, "sig", "left").join(diff, ["sig", "home"], "left")
        .join(followers.select(F.col("lead").alias("sig"), F.col("lmany").alias("own_many")), "sig", "left")
        .select(
            "sig", "n", "copies", F.coalesce("home", "sig").alias("home"), F.coalesce("followers", F.lit(0)).alias("followers"),
            F.coalesce("lmany", "own_many").alias("lmany"), F.coalesce("gone", nothing).alias("gone"), F.coalesce("extra", nothing).alias("extra"),
        )
    )


def _within(scratch: Scratch, members: DataFrame, t: int) -> DataFrame:
    """(sig, links) in a set's own home, in parts to be summed. Members are dealt into blocks of like differences."""
    in_use = members.groupBy("home").agg(F.count("*").alias("m")).filter("m > 1").select("home")
    rows = members.join(in_use, "home").select("*", F.size("gone").alias("d"), F.size("extra").alias("x"))
    kinds = rows.groupBy("home", "d", "x", "n").agg(F.count("*").alias("c"))
    before = Window.partitionBy("home").orderBy("d", "x", "n").rowsBetween(Window.unboundedPreceding, -1)
    kinds = kinds.select(
        "home", "d", "x", "n", F.floor(F.coalesce(F.sum("c").over(before), F.lit(0)) / BLOCK_SETS).alias("cell"), F.ceil(F.col("c") / BLOCK_SETS).alias("parts")
    )
    dealt = scratch.put(
        rows.join(kinds, ["home", "d", "x", "n"])
        .select("sig", "home", "n", "copies", "lmany", "d", "x", "gone", "extra", F.concat_ws("-", "cell", F.pmod(F.xxhash64("sig"), "parts")).alias("block"))
    )
    blocks = dealt.groupBy("home", "block").agg(
        F.max("lmany").alias("lmany"), F.sum("copies").alias("w"), *(f(c).alias(f"{f.__name__}_{c}") for c in ("d", "x", "n") for f in (F.min, F.max))
    )
    other = blocks.select("home", *(F.col(c).alias(f"o_{c}") for c in blocks.columns if c != "home"))
    sure = F.col("lmany") - F.col("max_d") - F.col("o_max_d") >= _wanted(t, F.col("max_n") + F.col("o_max_n"))
    most = F.col("lmany") - F.col("min_d") - F.col("o_min_d") + F.least("max_d", "o_max_d") + F.least("max_x", "o_max_x")
    pairs = blocks.join(other, "home").withColumn("sure", sure).filter(F.col("sure") | (most >= _wanted(t, F.col("min_n") + F.col("o_min_n"))))
    pairs = scratch.put(pairs.select("home", "block", "o_block", "o_w", "sure"))
    whole = pairs.filter("sure").groupBy("home", "block").agg(F.sum("o_w").alias("w"), F.max(F.col("block") == F.col("o_block")).alias("self"))
    counted = dealt.join(whole, ["home", "block"]).select("sig", (F.col("w") - F.when(F.col("self"), F.col("copies")).otherwise(0)).alias("links"))
    open_pairs = pairs.filter("not sure and block <= o_block").select("home", F.col("block").alias("low"), F.col("o_block").alias("high"))
    sides = open_pairs.withColumn("block", F.col("low")).unionByName(open_pairs.filter("low < high").withColumn("block", F.col("high")))
    compared = (
        sides.join(dealt.select("home", "block", "sig", "n", "copies", "lmany", "gone", "extra"), ["home", "block"])
        .select("home", "low", "high", (F.col("block") == F.col("low")).alias("first"), "sig", "n", "copies", "lmany", "gone", "extra")
        .groupBy("home", "low", "high").applyInArrow(_compare(t), "sig long, links long")
    )
    return counted.unionByName(compared)


def _compare(t: int):
    def links(table: pa.Table) -> pa.Table:
        """Links between the members of two blocks of a home, or inside of one: the leader's size less what either lacks,
        plus the differences they have in common."""
        same = table["low"][0].as_py() == table["high"][0].as_py()
        parts = []
        for first in (True,) if same else (True, False):
            part = table.filter(pa.compute.equal(table["first"], first))
            lists = [part[c].combine_chunks() for c in ("gone", "extra")]
            size = [np.diff(x.offsets.to_numpy()) for x in lists]
            row = np.concatenate([np.repeat(np.arange(len(s)), s) for s in size])
            token = np.concatenate([x.flatten().to_numpy() for x in lists])
            n, w = part["n"].to_numpy().astype(np.int64), part["copies"].to_numpy().astype(np.int64)
            parts.append((part["sig"].to_numpy(), n, w, size[0].astype(np.int64), row, token))
        a, b = parts[0], parts[-1]
        both = np.intersect1d(a[5], b[5])
        common = np.zeros((len(a[0]), len(b[0])), np.float32)
        for k in range(0, len(both), BLOCK_TOKENS):
            some = both[k : k + BLOCK_TOKENS]
            held = []
            for sig, _, _, _, row, token in (a, b):
                at = np.minimum(np.searchsorted(some, token), len(some) - 1)
                hit = some[at] == token
                x = np.zeros((len(sig), len(some)), np.float32)
                x[row[hit], at[hit]] = 1
                held.append(x)
            common += held[0] @ held[1].T
        shared = table["lmany"][0].as_py() - a[3][:, None] - b[3][None, :] + common.astype(np.int64)
        alike = 100 * shared >= t * (a[1][:, None] + b[1][None, :] - shared)
        if same:
            np.fill_diagonal(alike, False)
        sigs, counts = [a[0]], [alike @ b[2]]
        if not same:
            sigs.append(b[0])
            counts.append(alike.T @ a[2])
        return pa.table({"sig": pa.array(np.concatenate(sigs), pa.int64()), "links": pa.array(np.concatenate(counts), pa.int64())})

    return links


def _across(scratch: Scratch, postings: DataFrame, leaders: DataFrame, answers: DataFrame, members: DataFrame, sets: DataFrame, t: int) -> DataFrame:
    """(a, b, alike) of pairs of different homes that are in a list together and that the leaders' answers neither hold nor
    rule out."""
    beside = F.explode(F.array(F.col("block") - 1, F.col("block"), F.col("block") + 1)).alias("at")
    labelled = postings.join(members.select("sig", "home", "followers"), "sig")
    open_lists = labelled.groupBy("token").agg(F.min("home").alias("low"), F.max("home").alias("high")).filter("low < high").select("token")
    labelled = scratch.put(labelled.join(open_lists, "token").select("token", "block", "sig", "n", "pos", "home", "followers"))
    main = labelled.groupBy("token", "home").agg(F.count("*").alias("c")).groupBy("token").agg(F.max_by("home", F.struct("c", "home")).alias("main"))
    known = answers.select("sig", "lead", (1 - F.col("shared") / (F.col("n") + F.col("ln") - F.col("shared"))).alias("d"))
    to_lead = (
        labelled.select("token", "sig", "n", "pos", "home", "followers", "block", beside)
        .join(leaders.select("token", F.col("block").alias("at"), F.col("lead.sig").alias("lead")), ["token", "at"])
        .join(known, ["sig", "lead"], "left")
        .withColumn("d", F.when(F.col("sig") == F.col("lead"), 0.0).otherwise(F.col("d")))
    )
    # Blocks of a list by size and position; those that no pair of theirs can reach the overlap from are skipped.
    to_lead = to_lead.withColumn("slot", F.floor(F.col("pos") * 32 / F.col("n")).cast("int"))
    left = to_lead.join(main, "token").filter("home <> main")
    held = to_lead.filter("block = at").select("token", "at", *(F.col(c).alias(f"other_{c}") for c in ("sig", "n", "pos", "home", "followers", "d", "slot")))
    blocks = held.groupBy("token", "at", "other_slot").agg(F.min("other_pos").alias("from_pos"), F.min("other_n").alias("from_n"), F.max("other_n").alias("to_n"))
    reach = (
        left.join(blocks, ["token", "at"])
        .filter(1 + F.least(F.col("n") - F.col("pos") - 1, F.col("to_n") - F.col("from_pos") - 1) >= _wanted(t, F.col("n") + F.col("from_n")))
        .select("token", "at", "sig", "n", "pos", "home", "followers", "d", "other_slot")
    )
    rest = reach.join(held, ["token", "at", "other_slot"]).filter(
        (F.col("home") != F.col("other_home")) & F.coalesce(F.abs(F.col("d") - F.col("other_d")) <= 1 - t / 100 + 1e-9, F.lit(True)) & _reach(t)
    )
    # The set of the larger home is x: its leader's overlap with y is often known, and its own differs by its difference.
    larger = F.struct("followers", "sig") > F.struct(F.col("other_followers").alias("followers"), F.col("other_sig").alias("sig"))
    pairs = rest.select(F.when(larger, F.col("sig")).otherwise(F.col("other_sig")).alias("x"), F.when(larger, F.col("other_sig")).otherwise(F.col("sig")).alias("y")).distinct()
    done = answers.select(F.col("sig").alias("x"), F.col("lead").alias("y"))
    done = done.unionByName(done.select(F.col("y").alias("x"), F.col("x").alias("y")))
    pairs = scratch.put(pairs.join(done, ["x", "y"], "left_anti").join(members.select(F.col("sig").alias("x"), "home"), "x"))
    tokens = sets.select("sig", "tokens")
    asked = pairs.select("home", "y").distinct().join(answers.select(F.col("sig").alias("y"), F.col("lead").alias("home"), "shared"), ["home", "y"], "left")
    asked = scratch.put(asked)
    computed = (
        asked.filter("shared is null").select("home", "y").join(tokens.toDF("y", "tokens"), "y").join(tokens.toDF("home", "led"), "home")
        .select("home", "y", F.size(F.array_intersect("tokens", "led")).alias("base"))
    )
    base = scratch.put(asked.filter("shared is not null").select("home", "y", F.col("shared").alias("base")).unionByName(computed))
    shared = F.col("base") - F.size(F.array_intersect("gone", "tokens")) + F.size(F.array_intersect("extra", "tokens"))
    out = (
        pairs.join(base, ["home", "y"]).join(members.select(F.col("sig").alias("x"), F.col("n").alias("nx"), "gone", "extra"), "x")
        .join(sets.select(F.col("sig").alias("y"), F.col("n").alias("ny"), "tokens"), "y")
        .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "nx", "ny", shared.alias("shared"))
        .select("a", "b", _alike(t, "nx", "ny").alias("alike"))
    )
    out = scratch.put(out)
    scratch.drop(labelled, pairs, asked, base)
    return out
