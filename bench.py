"""Times headline queries; prints one line of JSON."""

import json
import os
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lineaspark.operators import candidates, linking, regions
from lineaspark.plans import queries, views

NAMES = (
    "region_features", "patch_features", "normalize_intensity", "label_overlap", "iou", "match_labels", "sliding_windows", "parental_norm", "average_over_windows",
    "candidate_pairs", "nearest_candidates", "link_greedy_frames", "tracklet_table", "lineage_closure", "associations", "window_counts",
)


def big_regions(spark, d):
    return regions.region_features(views.pixels_big(spark, d), 51, 11)


def big_links(spark, d):
    graph = candidates.build_graph(big_regions(spark, d), use_distance=True, max_distance=2.0, max_neighbors=4)
    return linking.link_greedy(graph, method="frames")


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    todo = {n: queries.QUERIES[n] for n in NAMES} | {"big_regions": big_regions, "big_links": big_links}
    views.pixels(spark, sf).agg(F.count("*")).collect()  # start-up is not counted
    times = {}
    for name, query in todo.items():
        start = time.perf_counter()
        query(spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "total seconds of headline queries", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf.rstrip("/"))}))


if __name__ == "__main__":
    main()
