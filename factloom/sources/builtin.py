"""Small built-in corpora and examples used by demos and tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom import schemas as S
from factloom.sources.readers import _DOCS, examples_jsonl

_EXAMPLE = (
    f"example_id string, question string, documents {_DOCS}, answers array<string>, stance string, "
    "gold_source_ids array<string>, gold_available boolean, split string, metadata map<string,string>"
)


def demo_documents(spark: SparkSession) -> DataFrame:
    """Four short notes for a retrieval demo."""
    rows = [
        ("tides", "Spring tides follow the new moon. Neap tides are weaker and come a week later.", "Tides"),
        ("buoys", "Green buoys stand to starboard when leaving port. A bell marks the outer buoy in fog.", "Buoys"),
        ("knots", "A bowline makes a loop that does not slip. The sheet bend joins ropes of unequal size.", "Knots"),
        ("lamps", "The lamp turns once in ten seconds. Its beam reaches twenty miles on a clear night.", "Lamps"),
    ]
    return spark.createDataFrame([(f"note-{d}", t, f"book-{d}", title) for d, t, title in rows], S.DOCUMENTS + ", title string")


def demo_corpus(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """Two sources that agree on one claim and disagree on another."""
    documents = spark.createDataFrame(
        [
            ("log-1", "The storm reached Keelham harbour on Monday. The storm damaged the north pier.", "log"),
            ("log-2", "The storm arrived at Keelham harbour on Monday. The storm did not damage the north pier.", "letter"),
        ],
        S.DOCUMENTS,
    )
    sources = spark.createDataFrame(
        [("log", "Harbour log", "2019-11-04", 0.9), ("letter", "Letter to the editor", "2019-11-20", 0.6)],
        "source_id string, title string, published_at string, reliability_prior double",
    ).withColumn("published_at", F.to_timestamp("published_at"))
    return documents, sources


#: The claims, priors and relations of the published four-claim trace, which its figures depend on.
def reasoning_demo(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Queries, claims and relations of the published four-claim trace."""
    queries = spark.createDataFrame([("demo", "did Acme revenue grow in 2023")], S.QUERIES)
    claims = spark.createDataFrame(
        [
            ("demo", "c1", "Acme revenue grew in 2023", "srcA", 0.8),
            ("demo", "c2", "Acme revenue increased in 2023", "srcB", 0.7),
            ("demo", "c3", "Acme revenue fell in 2023", "srcC", 0.6),
            ("demo", "c4", "Acme revenue grew in 2023", "srcA", 0.8),
        ],
        "query_id string, claim_id string, text string, source_id string, reliability_prior double",
    ).withColumn("extraction_confidence", F.lit(0.85))
    relations = spark.createDataFrame(
        [
            ("demo", "e1", "c2", "c1", S.SUPPORT, 0.85, "directed", ""),
            ("demo", "e2", "c1", "c3", S.CONTRADICTION, 0.8, "symmetric", ""),
            ("demo", "e3", "c1", "c4", S.DUPLICATE, 0.99, "symmetric", ""),
        ],
        S.RELATIONS,
    )
    return queries, claims, relations


def _examples(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    data = [
        (i, q, [(s, t, s, title) for s, t, title in docs], answers, stance, gold, True, "test", meta)
        for i, q, docs, answers, stance, gold, meta in rows
    ]
    return spark.createDataFrame(data, _EXAMPLE)


def synthetic_graph(spark: SparkSession) -> DataFrame:
    """Two questions: one that sources agree on, one they dispute."""
    agreed = [
        ("log", "The Dunhaven lifeboat rescued nine sailors in March.", "Station log"),
        ("paper", "Nine sailors were rescued by the Dunhaven lifeboat.", "Morning paper"),
        ("menu", "The canteen serves soup on weekdays.", "Canteen menu"),
    ]
    disputed = [
        ("owner", "The Pellwick ferry sailed at the announced hour.", "Owner's notice"),
        ("rider", "The Pellwick ferry sailed two hours late.", "Passenger letter"),
    ]
    return _examples(
        spark,
        [
            ("rescue", "How many sailors did the Dunhaven lifeboat rescue?", agreed, ["nine sailors"], "supports", ["log", "paper"], {}),
            ("sailing", "Did the Pellwick ferry sail on time?", disputed, ["sources disagree"], "not_enough_info", ["owner", "rider"], {}),
        ],
    )


def temporal_conflict(spark: SparkSession) -> DataFrame:
    """One question whose answer changed over the years."""
    documents = [
        ("atlas", "In 1975 the pilot station stood in Lowmere.", "Old atlas"),
        ("survey", "As of 2021 the pilot station stands in Saltholm.", "Survey"),
    ]
    return _examples(
        spark, [("station", "Where does the pilot station stand now?", documents, ["Saltholm"], "supports", ["survey"], {"focus": "supersession"})]
    )


DATASETS = {"synthetic_graph": synthetic_graph, "temporal_conflict": temporal_conflict}


def dataset(spark: SparkSession, name: str, path: str | None = None) -> DataFrame:
    """A built-in dataset by name, or a JSONL file when a path is given."""
    if path is not None:
        return examples_jsonl(spark, path)
    if name not in DATASETS:
        raise KeyError(f"unknown dataset {name!r}; built-in: {sorted(DATASETS)}")
    return DATASETS[name](spark)
