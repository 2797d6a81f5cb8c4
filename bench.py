"""Times the headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]`` and prints one line of JSON.

The bag of n-grams and the projection aren't timed by themselves, as ``tfidf`` and ``mlp_forward`` contain them. Each
query's whole result is written to a sink that discards it. ``queries`` has seconds; ``details`` has what is set
reference measures it, n-grams counted a second, and AUC of classifiers on this data.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.functions import subword
from glyphmill.operators import evaluation, ngrams
from glyphmill.plans import queries as Q
from glyphmill.session import session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = (
    "ngram_topk", "ngram_merge_exact", "vocab_idf", "tfidf", "mlp_forward", "tokenize_words", "normalize_lines", "byte_length_stats",
    "quantize", "gram_offdiag", "distill_loss", "auc", "streaming_shuffle", "stream_ngram_counts", "topk_sketch", "subword_tokenize", "subword_summary", "embed_documents",
)


def run(df: DataFrame) -> float:
    began = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began


def main() -> None:
    spark = session(f"local[{CPUS}]", "bench", spark__sql__shuffle__partitions=CPUS, spark__driver__memory="16g", spark__ui__enabled="false", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    run(Q.QUERIES["ngram_topk"](spark, "/root/testdata/sf0.001"))  # starts the JVM's compiler and the Python workers
    took: dict[str, float] = {}
    for name in HEADLINE:
        began = time.perf_counter()
        run(Q.QUERIES[name](spark, SF_DIR))
        took[name] = round(time.perf_counter() - began, 3)
    docs = Q.table(spark, SF_DIR, "documents").select("doc_id", "text").repartition(int(CPUS) * 4).persist()
    n = docs.count()
    model = Q.make_embedder(spark, SF_DIR)
    vectors = model.embed(docs)
    run(vectors)
    best = min(run(vectors) for _ in range(3))
    took["embed_ready_model"] = round(best, 3)
    tokens = subword.tokenize(docs.select("text"), subword.read_state(Q.TOKENIZER))
    total = ngrams.totals(tokens).first().total
    details = {"documents": n, "embed_docs_per_sec": round(n / best), "subword_1_to_5_grams": total, "ngrams_per_sec": round(total / took["subword_summary"])}
    for name in ("logreg_on_embeddings", "mlp_on_embeddings", "bigram_baseline"):
        began = time.perf_counter()
        scored = Q.QUERIES[name](spark, SF_DIR).persist()
        details[f"{name}_auc"] = round(evaluation.auc(scored, F.col("label"), F.col("score")).first()[0], 4)
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": SF_DIR.rstrip("/").rsplit("sf", 1)[-1], "cpus": CPUS, "details": details}))
    spark.stop()


if __name__ == "__main__":
    main()
