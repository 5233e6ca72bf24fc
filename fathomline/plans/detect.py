"""Detection: from regions, queries and a bank to labelled, scored and suppressed boxes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.config import EngineConfig
from fathomline.operators.boxes import cap_proposals, nms
from fathomline.operators.labels import image_boost, query_boost, resolve_labels
from fathomline.operators.scoring import add_boost, best_label, label_scores, with_confidence
from fathomline.operators.search import batch_knn, merge_hits, select_candidates
from fathomline.staging import Scratch

REGION = ("region_id", "image_id", "objectness", "x1", "y1", "x2", "y2")


class Engine:
    """Retrieval-based detection over one bank ``(id, label, modality, embedding, ...)``."""

    def __init__(self, bank: DataFrame, config: EngineConfig | None = None):
        self.bank = bank
        self.config = config or EngineConfig()
        self.scratch = Scratch(bank.sparkSession, "detect")

    def retrieve(self, queries: DataFrame, mode: str = "text", image_queries: DataFrame | None = None, top_k: int | None = None, metadata: dict[str, object] | None = None) -> DataFrame:
        """Hits of ``queries(query_id, embedding)``: by text, by image, or both merged."""
        k = top_k or self.config.retrieval.top_k

        def of(rows: DataFrame, modality: str) -> DataFrame:
            return batch_knn(rows, select_candidates(self.bank, modality, metadata), k)

        if mode == "text":
            return of(queries, "text")
        if mode == "image":
            if image_queries is None:
                raise ValueError("image mode needs image queries")
            return of(image_queries, "image")
        if mode == "hybrid":
            hits = of(queries, "text")
            return merge_hits(hits, of(image_queries, "image"), k) if image_queries is not None else hits
        raise ValueError(f"unsupported retrieval mode: {mode}")

    def _staged(self, rows: DataFrame) -> DataFrame:
        """Rows that several parts of a plan read, written once below the checkpoint folder."""
        return self.scratch.save(rows)

    def _shown(self, regions: DataFrame) -> DataFrame:
        """The regions that are looked at: the first of each image, or all."""
        most = self.config.retrieval.most_proposals
        return regions if most is None else cap_proposals(regions.withColumn("_seq", F.col("region_id")), most, order="_seq").drop("_seq")

    def _detections(self, hits: DataFrame, regions: DataFrame, boost: DataFrame, keys: list[str], boost_on: list[str]) -> DataFrame:
        """Hits of regions to boxes with their best label; not yet suppressed."""
        scores = add_boost(label_scores(hits, keys, self.config), boost, boost_on, self.config)
        best = best_label(scores, keys, self.config)
        evidence = hits.groupBy(*keys, "label").agg(F.slice(F.sort_array(F.collect_list(F.struct("rank", F.col("id").alias("ref_id"), "score", "modality"))), 1, self.config.retrieval.top_k).alias("top_k_scores"))
        made = with_confidence(best.join(regions.select(*REGION), "region_id"))
        return made.join(evidence, [*keys, "label"]).withColumnRenamed("agg", "score").withColumn("seq", F.col("region_id"))

    def _suppressed(self, found: DataFrame, call: list[str]) -> DataFrame:
        """Boxes at or above the threshold that survive suppression within an image and label."""
        c = self.config
        scope = ["image_id", "label", *call, *(["query_id"] if c.suppression.scope == "per_query" and "query_id" in found.columns else [])]
        if "query_id" in found.columns:  # boxes of several queries share a region
            found = found.withColumn("seq", F.struct("region_id", "query_id"))
        return nms(self._staged(found), scope, c.suppression.overlap, least=c.suppression.least).drop("seq")

    def detect_text(self, regions: DataFrame, queries: DataFrame, metadata: dict[str, object] | None = None) -> DataFrame:
        """Detections of text queries ``(query_id, query_label, embedding)`` in ``regions`` (REGION and embedding)."""
        c = self.config
        bank = select_candidates(self.bank, "text", metadata)
        own = queries.where(F.trim("query_label") != "")
        hits = self._staged(batch_knn(own, bank, c.retrieval.top_k))
        labels = self._staged(resolve_labels(hits, own, c))
        boost = query_boost(hits, labels)
        shown = self._shown(regions)
        if c.retrieval.own_candidates_only:
            # Other labels' candidates are no evidence; their pairs need not be made.
            candidates = self._staged(hits.join(labels, ["query_id", "label"]).select("query_id", "id").distinct())
            listed = bank.join(candidates.select("id").distinct(), "id", "left_semi")
            region_hits = batch_knn(shown, listed, None, "region_id").join(candidates, "id")
        else:
            region_hits = batch_knn(shown, bank, c.retrieval.top_k, "region_id")
        asked = self._staged(region_hits.join(labels, (["query_id"] if "query_id" in region_hits.columns else []) + ["label"]))
        return self._suppressed(self._detections(asked, shown, boost, ["query_id", "region_id"], ["query_id", "label"]), [])

    def detect_image(self, regions: DataFrame, query_images: DataFrame, query_image_agg: str = "mean", metadata: dict[str, object] | None = None) -> DataFrame:
        """Detections of query images ``(query_id, embedding)``, whose hits are pooled into one boost per label."""
        c = self.config
        bank = select_candidates(self.bank, "image", metadata)
        boost = self._staged(image_boost(batch_knn(query_images, bank, c.retrieval.top_k), query_image_agg))
        shown = self._shown(regions)
        hits = self._staged(batch_knn(shown, bank, c.retrieval.top_k, "region_id").join(boost.select("label"), "label", "left_semi"))
        return self._suppressed(self._detections(hits, shown, boost, ["region_id"], ["label"]), [])

    def detect_hybrid(self, regions: DataFrame, queries: DataFrame, query_images: DataFrame, query_image_agg: str = "mean") -> DataFrame:
        """Text and image detections side by side; they do not suppress each other."""
        text = self.detect_text(regions, queries).withColumn("source", F.lit("text_query"))
        image = self.detect_image(regions, query_images, query_image_agg).withColumn("source", F.lit("image_query"))
        return text.unionByName(image, allowMissingColumns=True)


def detections_json(found: DataFrame, config: EngineConfig, per: list[str] | None = None, facts: dict[str, object] | None = None) -> DataFrame:
    """One JSON payload per ``per`` (image): number of detections, the detections, best first, and the facts of the call.

    ``facts`` are written as they are, such as the queries and the pooling of query images; the image is
    the value of the first column of ``per``.
    """
    keys = per or ["image_id"]
    evidence = config.evidence
    about = F.struct(F.lit(evidence.method).alias("method"), F.lit(evidence.temperature).alias("temperature"), F.lit(evidence.best).alias("top_m"))
    item = F.struct((-F.col("confidence")).alias("_order"), "label", F.array("x1", "y1", "x2", "y2").alias("box"), "score", "confidence", "objectness", "top_k_scores", "margin", about.alias("aggregation"))
    grouped = found.groupBy(*keys).agg(F.count("*").alias("num_detections"), F.sort_array(F.collect_list(item)).alias("d"))
    detections = F.transform("d", lambda x: x.dropFields("_order"))
    about_call = [F.col(keys[0]).alias("image"), *[(F.array(*map(F.lit, v)).cast("array<string>") if isinstance(v, (list, tuple)) else F.lit(v)).alias(k) for k, v in facts.items()]] if facts is not None else []
    return grouped.select(*keys, "num_detections", F.to_json(F.struct("num_detections", detections.alias("detections"), *about_call)).alias("payload"))
