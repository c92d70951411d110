import json

from larder.functions.versions import latest_tag, natural_key
from larder.sources.paged import PagedSource


def test_paged_source(spark, tmp_path):
    for page in (1, 3):  # the second page is missing
        (tmp_path / f"p{page}.json").write_text(json.dumps({"pagination": {"totalPages": 3}, "_embedded": {"products": [{"id": page}]}}))
    spark.dataSource.register(PagedSource)
    got = spark.read.format("paged_json").option("url", f"file://{tmp_path}/p{{page}}.json").option("pause", "0").load().collect()
    assert sorted(r.page for r in got) == [1, 3] and json.loads(got[0].body)["pagination"]["totalPages"] == 3


def test_versions(spark):
    tags = spark.createDataFrame([("v1.9", None), ("v1.10", None), ("v1.2", None)], "tag string, position int")
    assert latest_tag(tags).first().tag == "v1.10" == max(["v1.9", "v1.10", "v1.2"], key=natural_key)
    assert latest_tag(tags.unionByName(spark.createDataFrame([("v0", 3), ("v1", 7)], "tag string, position int"))).first().tag == "v0"
