"""The memory service: the tools over a store of snapshot tables, each for a batch of requests.

Reads never write. A write reads its tables as of one commit and ends in one commit of all
that it changed and of the interaction log; a write that another one overtook raises
`Conflict` and leaves nothing. Episodes, facts and edges are laid out by ranges of ids, and
a write rewrites the ranges of the rows that it changes; `dream`, which ages all edges, and
`reembed` write whole tables, and so does the buffer of candidates.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engrama.config import DEFAULT, Config
from engrama.functions import text as tx
from engrama.functions import vectors as vx
from engrama.operators import codes, consolidate, copies, filters, lifecycle
from engrama.operators import graph as gr
from engrama.operators import recall as rc
from engrama.operators.store import SPAN, Ranges, Store, by_ids, delete_ids, event_log_tail, next_ids
from engrama.operators.vector_index import VectorIndex

EPISODIC = (
    "id long, content string, embedding array<float>, session_id string, scope string, tags array<string>, salience double, created_at double, last_accessed double, retrieval_count int,"
    " access_history array<double>, consolidated_into long, dg_support array<int>, episode_group_id long, position_in_episode int, segment_count int, drift_total double, drift_locked boolean, last_reconsolidated_at double"
)
SEMANTIC = (
    "id long, content string, embedding array<float>, kind string, source_episode_ids array<long>, tags array<string>, confidence double, created_at double, updated_at double, last_accessed double,"
    " authored boolean, scope string, session_id string"
)
EDGES = "kind string, src_id long, dst_id long, weight double, bonus double, hits long, last_touch double"
LOG = "seq long, ts double, kind string, session_id string, deduped boolean"
TABLES = {"episodic": EPISODIC, "semantic": SEMANTIC, "edges": EDGES, "interaction_log": LOG, "schema_candidates": consolidate.CANDIDATES}

#: The tables that are laid out by ranges of a key; an edge is where its source is.
KEYS = {"episodic": "id", "semantic": "id", "edges": "src_id"}


class Memory:
    def __init__(self, spark: SparkSession, root: str, loader: Callable, cfg: Config = DEFAULT, model: str = "", index: str | None = None, span: int = SPAN):
        """loader() gives an embedder, list of texts -> matrix; it runs once for each worker's stream of batches.

        model: the embedder's name, by which texts of documents and of queries get their prefixes.
        index: a folder for inverted-file indexes, by which recall then searches; by default it searches exactly.
        span: how many ids make a range, the least that a write rewrites; a store keeps the span of its tables' first writes.
        """
        self.spark, self.store, self.loader, self.cfg = spark, Store(spark, root, span), loader, cfg
        self.document_prefix, self.query_prefix = tx.prefixes(model)
        self._indexes = {name: VectorIndex(spark, f"{index.rstrip('/')}/{name}") for name in ("episodic", "semantic")} if index else {}
        self._base: int | None = None
        self._changed: dict[str, DataFrame | Ranges] = {}
        self._held: list[DataFrame] = []

    def table(self, name: str, ranges: list[int] | None = None) -> DataFrame:
        commit = self.store.latest() if self._base is None else self._base
        try:
            return self.store.read(name, commit, ranges) if commit else self.spark.createDataFrame([], TABLES[name])
        except KeyError:
            return self.spark.createDataFrame([], TABLES[name])

    @contextmanager
    def _write(self) -> Iterator[None]:
        """All that is set inside becomes one commit; inside, tables are read as of its beginning."""
        self._base, self._changed = self.store.latest(), {}
        try:
            yield
            if self._changed:
                self.store.commit_all(self._changed, self._base)
        finally:
            self._base, self._changed = None, {}
            self.release()

    def _ranges(self, name: str, ids: DataFrame) -> list[int] | None:
        """The ranges of a table that hold the ids, as of the write's beginning; None: the whole table."""
        return self.store.ranges_of(name, ids, self._base)

    def _commit(self, name: str, df: DataFrame, ranges: list[int] | None = None) -> None:
        """df becomes the table, or what its ranges hold."""
        wanted = self.spark.createDataFrame([], TABLES[name])
        df = wanted.unionByName(df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in wanted.schema if f.name in df.columns]), allowMissingColumns=True)
        change = Ranges(df, KEYS[name], ranges) if name in KEYS else df
        if self._base is None:
            self.store.commit(name, change)
        else:
            self._changed[name] = change

    def _remove(self, name: str, gone: DataFrame) -> None:
        """Rows of the ids go."""
        ranges = self._ranges(name, gone)
        if ranges != []:
            self._commit(name, delete_ids(self.table(name, ranges), gone), ranges)

    def _remove_edges(self, gone: DataFrame) -> None:
        """Edges with one of the ids at either end go."""
        edges = self.table("edges").select("src_id", "dst_id")
        hit = edges.join(gone.select(F.col("id").alias("src_id")), "src_id", "left_semi").unionByName(edges.join(gone.select(F.col("id").alias("dst_id")), "dst_id", "left_semi").select("src_id", "dst_id"))
        ranges = self._ranges("edges", hit.select(F.col("src_id").alias("id")))
        if ranges != []:
            self._commit("edges", delete_ids(delete_ids(self.table("edges", ranges), gone, "src_id"), gone, "dst_id"), ranges)

    def _hold(self, df: DataFrame) -> DataFrame:
        """Keeps what is read several times, until `release`."""
        self._held.append(df.persist())
        return df

    def release(self) -> None:
        """Lets go of what reads and writes have kept; writes do so by themselves."""
        while self._held:
            self._held.pop().unpersist()

    def _log(self, kind: str, now: float, events: DataFrame | None = None) -> None:
        log = self.table("interaction_log")
        last = log.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("m")).first().m
        new = events if events is not None else self.spark.createDataFrame([(None, None)], "session_id string, deduped boolean")
        rows = [(last + i + 1, float(now), kind, r.session_id, r.deduped) for i, r in enumerate(new.limit(self.cfg.log_capacity).collect())]  # log_capacity at most
        self._commit("interaction_log", event_log_tail(log.unionByName(self.spark.createDataFrame(rows, LOG)), self.cfg.log_capacity))

    def _embedded(self, texts: DataFrame) -> DataFrame:
        return codes.embed(texts, "query", self.loader, self.query_prefix, char_cap=self.cfg.embed_char_cap).withColumnRenamed("embedding", "vector")

    # writes

    def store_episodes(self, new: DataFrame, now: float) -> dict[str, int]:
        """new: content, session_id, tags, salience (null: derived) and, if wanted, supersedes. Repeats bump what they repeat.

        supersedes: an episode that goes, with its whole group and edges, once the new one
        is stored, unless the new one repeats that very group.
        """
        checked = new.withColumns({"k": F.lit(1), "_error": F.lit(None).cast("string")})
        bad = checked.withColumn("_error", filters.input_error(checked, self.cfg)).where("_error is not null").select("_error").first()
        if bad:
            raise ValueError(bad[0])
        new = new if "supersedes" in new.columns else new.withColumn("supersedes", F.lit(None).cast("long"))
        with self._write():
            old = self.table("episodic")
            self._check_superseded(new, old)
            inserts, bumps = consolidate.encode(new, old, self.loader, now, self.cfg, self.document_prefix, self._hold)
            inserts, bumps = self._hold(inserts), self._hold(bumps)
            grouped = inserts.withColumn("episode_group_id", F.when(F.col("segment_count") > 1, F.col("id")))
            fresh = grouped.where("position_in_episode = 0").withColumn("scope", F.lit("session"))
            more = next_ids(old.select("id").unionByName(fresh.select("id")), grouped.where("position_in_episode > 0").withColumn("scope", F.lit("session")).withColumn("dg_support", F.lit(None).cast("array<int>")), ["episode_group_id", "position_in_episode"])
            added = fresh.unionByName(more.select(fresh.columns)).withColumns({"last_accessed": F.lit(float(now)), "access_history": F.array(F.lit(float(now)))})
            added = self._hold(added.select(*[F.col(c) if c in added.columns else F.lit(None).cast(old.schema[c].dataType).alias(c) for c in old.columns]))
            group = F.coalesce("episode_group_id", "id")
            into = fresh.select("supersedes", group.alias("new_group")).unionByName(bumps.select("id", "supersedes").join(old.select("id", group.alias("new_group")), "id").select("supersedes", "new_group"))
            into = self._hold(into.where("supersedes is not null").select(F.col("supersedes").alias("target"), "new_group"))
            counts = {"stored": inserts.count(), "repeated": bumps.count(), "superseded": into.count()}
            touched = added.select("id").unionByName(bumps.select("id"))
            if counts["superseded"]:
                groups = old.select("id", "episode_group_id").unionByName(added.select("id", "episode_group_id"))
                gone = self._hold(groups.select("id").join(consolidate.supersede(groups, into).select("id"), "id", "left_anti"))
                touched = touched.unionByName(gone)
                self._remove_edges(gone)
            ranges = self._ranges("episodic", touched)
            base = lifecycle.bump(self.table("episodic", ranges), bumps.select("id", "t"), self.cfg.access_history_cap).unionByName(added)
            self._commit("episodic", delete_ids(base, gone) if counts["superseded"] else base, ranges)
            log = fresh.select("session_id", F.lit(False).alias("deduped")).unionByName(bumps.select("session_id", F.lit(True).alias("deduped")))
            self._log("encode", now, log)
        return counts

    def _check_superseded(self, new: DataFrame, old: DataFrame) -> None:
        asked = new.where("supersedes is not null").select(F.col("supersedes").cast("long").alias("id"))
        bad = asked.where("id < 0").unionByName(asked.join(old.select("id"), "id", "left_anti")).first()
        if bad:
            raise ValueError(f"supersedes {bad.id}: no such record")

    def store_semantic(self, new: DataFrame, now: float) -> int:
        """new: content, kind, tags, confidence, scope, session_id and, if wanted, supersedes: a fact that the new one takes the place of."""
        error = new.select(filters.scope_error(F.col("scope"), F.col("session_id")).alias("e")).where("e is not null").first()
        if error:
            raise ValueError(error.e)
        new = new if "supersedes" in new.columns else new.withColumn("supersedes", F.lit(None).cast("long"))
        with self._write():
            old = self.table("semantic")
            self._check_superseded(new, old)
            tags = F.array_sort(F.array_distinct(F.filter("tags", lambda t: t != "")))
            rows = codes.embed(new, "content", self.loader, self.document_prefix, char_cap=self.cfg.embed_char_cap).withColumns({
                "scope": filters.resolve_scope(F.col("scope"), F.col("session_id")), "tags": tags, "authored": F.lit(True), "kind": F.coalesce("kind", F.lit("fact")), "confidence": F.coalesce("confidence", F.lit(1.0)),
                "created_at": F.lit(float(now)), "updated_at": F.lit(float(now)), "source_episode_ids": F.array().cast("array<long>"), "last_accessed": F.lit(None).cast("double"),
            })
            numbered = self._hold(next_ids(old.select("id"), rows, ["content"]))
            n = numbered.count()
            taken = numbered.where("supersedes is not null").select(F.col("supersedes").alias("id"))
            ranges = self._ranges("semantic", numbered.select("id").unionByName(taken))
            kept = delete_ids(self.table("semantic", ranges), taken)
            self._commit("semantic", kept.select(old.columns).unionByName(numbered.select(old.columns)), ranges)
            self._log("store_semantic", now)
        return n

    def remove_episodes(self, ids: list[int], dry_run: bool = True) -> list[int]:
        """The ids of the whole groups that go; edges go with them."""
        with self._write():
            e = self.table("episodic")
            group = F.coalesce("episode_group_id", "id")
            groups = by_ids(e, ids).select(group.alias("g")).distinct()
            gone = self._hold(e.withColumn("g", group).join(groups, "g", "left_semi").select("id"))
            found = sorted(r.id for r in gone.collect())  # of the ids asked for
            if not dry_run and found:
                self._remove("episodic", gone)
                self._remove_edges(gone)
        return found

    def remove_semantic(self, ids: list[int]) -> None:
        """Facts go; what episodes say they were consolidated into stays, on purpose."""
        with self._write():
            self._remove("semantic", self.spark.createDataFrame([(int(i),) for i in ids], "id long"))

    def forget(self, now: float, floor: float = DEFAULT.strength_floor, dry_run: bool = True) -> dict[str, int]:
        with self._write():
            e, s = self.table("episodic"), self.table("semantic")
            gone = self._hold(lifecycle.forgettable(e, now, floor, self.cfg).select("id"))
            cold = self._hold(lifecycle.cold_schemas(s, now, self.cfg.schema_unused_seconds).select("id"))
            counts = {"episodes": gone.count(), "schemas": cold.count()}
            if not dry_run:
                if counts["episodes"]:
                    self._remove("episodic", gone)
                    self._remove_edges(gone)
                if counts["schemas"]:
                    self._remove("semantic", cold)
                self._log("forget", now)
        return counts

    def consolidate(self, now: float, epoch: int, session_id: str | None = None) -> dict[str, int]:
        """A pass: ages candidates, absorbs, clusters, promotes; episodes point at their schema."""
        with self._write():
            e, s = self.table("episodic"), self.table("semantic")
            ready = filters.eligible(filters.unconsolidated(e, session_id), now, self.cfg)
            done = consolidate.consolidate(ready, s, self.table("schema_candidates"), epoch, now, self.cfg)
            merged = self._hold(done.absorbed.select("id", "schema").unionByName(done.decisions.where("decision = 'merge'").select(F.explode("sources").alias("id"), F.col("target").alias("schema"))))
            new = self._hold(done.decisions.where("decision in ('promote', 'fast_promote')").select("gist", "sources"))
            members = new.select("gist", F.explode("sources").alias("id")).join(e.select("id", "session_id", "tags"), "id")
            winner = lifecycle.plurality(members, "gist", "session_id")
            tags = members.select("gist", F.explode_outer("tags").alias("t")).groupBy("gist").agg(F.array_sort(F.collect_set("t")).alias("tags"))
            rows = codes.embed(new.join(winner, "gist").join(tags, "gist").withColumnRenamed("gist", "content"), "content", self.loader, self.document_prefix, char_cap=self.cfg.embed_char_cap)
            rows = rows.withColumns({
                "source_episode_ids": F.col("sources"), "confidence": lifecycle.confidence(F.size("sources"), self.cfg.confidence_full_at), "session_id": F.col("winner"), "scope": F.when(F.col("winner").isNull(), "global").otherwise("session"),
                "created_at": F.lit(float(now)), "updated_at": F.lit(float(now)), "last_accessed": F.lit(float(now)), "authored": F.lit(False), "kind": F.lit(None).cast("string"),
            })
            added = self._hold(next_ids(s.select("id"), rows, ["content"]))
            into = merged.union(added.select(F.explode("source_episode_ids").alias("id"), F.col("id").alias("schema"))).groupBy("id").agg(F.min("schema").alias("_into"))
            into = self._hold(into)
            counts = {"absorbed": done.absorbed.count(), "merged": done.decisions.where("decision = 'merge'").count(), "promoted": added.count(), "parked": done.decisions.where("decision = 'park'").count()}
            if counts["absorbed"] + counts["merged"] + counts["promoted"]:
                ranges = self._ranges("semantic", added.select("id").union(merged.select("schema")))
                schemas = lifecycle.merge_into_schema(self.table("semantic", ranges), merged, now, self.cfg)
                self._commit("semantic", schemas.unionByName(added.select(schemas.columns)), ranges)
                ranges = self._ranges("episodic", into)
                episodes = self.table("episodic", ranges).join(into, "id", "left").withColumn("consolidated_into", F.coalesce("_into", "consolidated_into")).drop("_into")
                self._commit("episodic", episodes, ranges)
            self._commit("schema_candidates", done.candidates)
            self._log("consolidate", now)
        return counts

    def dream(self, now: float) -> dict[str, int]:
        """Decay of edges, then rehearsal of the strongest records of each session."""
        with self._write():
            edges = self.table("edges")
            decayed = self._hold(gr.ltd(edges, now, self.cfg))
            kept = decayed.where("not pruned").drop("pruned")
            replayed = self._hold(lifecycle.replay_edges(self.table("episodic"), now, self.cfg))
            counts = {"pruned": decayed.where("pruned").count(), "replayed": replayed.count()}
            self._commit("edges", self._reinforced(edges.where("kind = 'sr'").unionByName(kept.select(edges.columns)), replayed.select(F.col("anchor").alias("src_id"), F.col("target").alias("dst_id"), "score"), now))
            self._log("dream", now)
        return counts

    def _reinforced(self, edges: DataFrame, touches: DataFrame, now: float) -> DataFrame:
        """edges after one touch of each (src_id, dst_id, score)."""
        folded = gr.plasticity_fold(touches.withColumns({"t": F.lit(float(now)), "seq": F.lit(0)}), self.cfg).select("src_id", "dst_id", F.col("bonus").alias("_gain"), F.col("weight").alias("_weight"), F.col("hits").alias("_hits"))
        old = edges.where("kind = 'plasticity'").join(folded, ["src_id", "dst_id"], "full")
        z = lambda c: F.coalesce(c, F.lit(0))
        merged = old.select(
            F.lit("plasticity").alias("kind"), "src_id", "dst_id", (z("weight") + z("_weight")).alias("weight"), (z("bonus") + z("_gain")).alias("bonus"), (z("hits") + z("_hits")).alias("hits"),
            F.when(F.col("_hits").isNotNull(), F.lit(float(now))).otherwise(F.col("last_touch")).alias("last_touch"),
        )
        return edges.where("kind <> 'plasticity'").unionByName(merged.select(edges.columns))

    def reembed(self, loader: Callable, dim: int, model: str = "", work: str | None = None) -> dict[str, int]:
        """Embeds all contents anew for another embedder, ids unchanged, and checks the result; one commit, or none if a check fails.

        work: a folder in which a run that is broken off leaves what it has done, and another goes on with it.
        """
        document, query = tx.prefixes(model)
        counts = {}
        with self._write():
            for name in ("episodic", "semantic"):
                old = self.table(name)
                if work:
                    new = copies.reembed(old, loader, f"{work.rstrip('/')}/{name}", document, char_cap=self.cfg.embed_char_cap)
                else:
                    new = self._hold(codes.embed(old.drop("embedding"), "content", loader, document, char_cap=self.cfg.embed_char_cap))
                checks = codes.verify_embeddings(new, "content", loader, dim, document, self.cfg.embed_char_cap).first()
                counts[name] = checks.n
                if checks.n and not (checks.ok and checks.n == old.count()):
                    raise ValueError(f"{name}: {checks.n_bad} of {checks.n} vectors are not of {dim} finite values, or drift by {checks.max_drift}")
                if lost := copies.self_search(new).first():
                    raise ValueError(f"{name}: row {lost.query_id} does not find itself")
                self._commit(name, codes.with_support(new, self.cfg) if name == "episodic" else new)
        self.loader, self.document_prefix, self.query_prefix = loader, document, query
        return counts

    def backup(self, path: str) -> dict[str, int]:
        """Copies of all tables as of one commit, each compared with its source; rows by table."""
        return {name: copies.verified_copy(self.table(name), f"{path.rstrip('/')}/{name}").count() for name in TABLES}

    # reads

    def recall(self, queries: DataFrame, k: int = 4, scope: bool | None = None, reinforce_at: float | None = None, tags: tuple[str, ...] = ()) -> DataFrame:
        """queries: query_id, query, session_id. scope: None, queries with a session see what that may see, others all; True, every query needs a session; False, all see all. tags: what episodic hits must all have. With reinforce_at the hits' records and edges are strengthened.

        With cfg.completion_iters the query vectors are first completed by their neighbours
        in both stores.
        """
        if scope and (bare := queries.where("session_id is null").first()):
            raise ValueError(f"scope asks for a session_id, query {bare.query_id} has none")
        q = self._hold(self._completed(self._embedded(queries), k))
        e, s, edges = self.table("episodic"), self.table("semantic"), self.table("edges")
        sr = edges.where("kind = 'sr'")
        total = sr.agg(F.coalesce(F.sum("hits"), F.lit(0)).alias("t")).first().t
        closure = lambda anchors: gr.power_series(sr.selectExpr("src_id as src", "dst_id as dst", "hits"), self.cfg.sr_gamma, 2, anchors)
        of = lambda name, df: codes.background_reference(df, q, self.cfg).withColumn("source", F.lit(name))
        references = of("episodic", e).unionByName(of("semantic", s))
        hits = self._hold(rc.recall(e, s, q, closure, edges, references, gr.omega(int(total), e.count(), self.cfg), k, self.cfg, scope, tuple(tags), self._search if self._indexes else None))
        text = e.select("id", "content").withColumn("source", F.lit("episodic")).unionByName(s.select("id", "content").withColumn("source", F.lit("semantic")))
        found = filters.snippet(hits.join(text, ["id", "source"]), self.cfg.snippet_chars)
        if reinforce_at is not None:
            rows, schema = found.collect(), found.schema  # queries x k rows
            self._reinforce(hits, q, reinforce_at)
            found = self.spark.createDataFrame(rows, schema)
        return found

    def _search(self, source: str, df: DataFrame, queries: DataFrame, k: int) -> DataFrame:
        """By the index, which the guard first brings up to date."""
        return self._indexes[source].search(df.select("id", "embedding"), queries, k)

    def _completed(self, q: DataFrame, k: int) -> DataFrame:
        if self.cfg.completion_iters <= 0:
            return q
        if self.document_prefix != self.query_prefix:
            q = codes.embed(q, "query", self.loader, self.document_prefix, char_cap=self.cfg.embed_char_cap).withColumnRenamed("embedding", "document")
        stores = [self.table("episodic"), self.table("semantic")]
        return codes.complete_nearest(stores, self._hold(q), self.cfg.completion_iters, max(k, 8), self.cfg.completion_beta, self.cfg.completion_anchor).drop("document")

    def _reinforce(self, hits: DataFrame, queries: DataFrame, now: float) -> None:
        """Bumps returned records; ties the nearest to the others, by co-access and by score; draws the nearest toward its query."""
        with self._write():
            ep = hits.where("source = 'episodic'")
            ranges = self._ranges("episodic", ep)
            bumped = lifecycle.bump(self.table("episodic", ranges), ep.select("id", F.lit(float(now)).alias("t")), self.cfg.access_history_cap)
            anchor = ep.groupBy("query_id").agg(F.min_by(F.struct("id", "distance"), F.struct("distance", "position")).alias("a")).select("query_id", F.col("a.id").alias("anchor"), F.col("a.distance").alias("_near"))
            pairs = self._hold(ep.join(anchor, "query_id").where("id <> anchor").select(F.col("anchor").alias("src_id"), F.col("id").alias("dst_id"), vx.score("distance").alias("score")))
            sources = self._ranges("edges", pairs.select(F.col("src_id").alias("id")))
            edges = self._reinforced(self.table("edges", sources), pairs.groupBy("src_id", "dst_id").agg(F.max("score").alias("score")), now)
            seen = pairs.groupBy("src_id", "dst_id").agg(F.count(F.lit(1)).alias("_n"))
            sr = edges.where("kind = 'sr'").join(seen, ["src_id", "dst_id"], "full")
            z = lambda c: F.coalesce(c, F.lit(0))
            sr = sr.select(F.lit("sr").alias("kind"), "src_id", "dst_id", F.lit(0.0).alias("weight"), F.lit(0.0).alias("bonus"), (z("hits") + z("_n")).alias("hits"), F.lit(float(now)).alias("last_touch"))
            cues = anchor.join(queries.select("query_id", "vector"), "query_id").groupBy(F.col("anchor").alias("id")).agg(F.max(vx.score("_near")).alias("score"), F.min_by("vector", "_near").alias("cue"))
            self._commit("edges", edges.where("kind <> 'sr'").unionByName(sr.select(edges.columns)), sources)
            self._commit("episodic", lifecycle.drift(bumped, cues, now, self.cfg), ranges)
            self._log("recall", now)

    def recall_semantic(self, queries: DataFrame, k: int = 8, kind: str | None = None) -> DataFrame:
        """Facts and schemas; queries without any fall back to a few episodes."""
        q = self._hold(self._embedded(queries))
        s, e = self.table("semantic"), self.table("episodic")
        hits = rc.recall_semantic(s, q, codes.background_reference(s, q, self.cfg), k, kind, self.cfg)
        if not self.cfg.semantic_fallback:
            return hits.select("query_id", "position", "id", "distance", F.lit(False).alias("fallback"))
        near = rc.knn(e, q, self.cfg.semantic_fallback_k).withColumnRenamed("nth", "position")
        return rc.with_fallback(hits, near, self.cfg.semantic_fallback_k)

    def get_episode(self, episode_id: int, session_id: str | None = None) -> str:
        """The whole text of the episode that a segment belongs to."""
        e = self.table("episodic")
        row = e.where(F.col("id") == episode_id).select(F.coalesce("episode_group_id", "id").alias("g")).first()
        parts = e.where(F.coalesce("episode_group_id", "id") == row.g) if row else None
        rows = parts.where(filters.visible(F.lit(session_id))).orderBy("position_in_episode").select("content").collect() if row else []
        if not rows:
            raise KeyError(f"no episode {episode_id}")
        return "".join(r.content for r in rows)

    def reflect(self, session_id: str, query: str | None = None, k: int = 5) -> dict[str, DataFrame]:
        recent = lifecycle.reflect_recent(self.table("episodic"), session_id, k, self.cfg)
        first = recent.select("tags").first()
        seed = query or (first.tags[0] if first and first.tags else None)
        if seed is None:
            return {"recent": recent, "schemas": self.table("semantic").where("false")}
        q = self._embedded(self.spark.createDataFrame([(0, seed)], "query_id long, query string"))
        near = rc.knn(self.table("semantic"), q, rc.fetch_k(k, True), ("scope", "session_id", "content")).where(filters.visible(F.lit(session_id)))
        return {"recent": recent, "schemas": near.orderBy("distance", "id").limit(k)}

    def stats(self) -> dict[str, int]:
        return {name: self.table(name).count() for name in TABLES}
