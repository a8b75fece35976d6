import json

import pytest
from paramill.functions import constraints as c
from paramill.sources import parameters
from pyspark.sql import functions as F

FULL = {
    "长": "10", "宽": "5", "高": "1.5", "flow_type": "horizontal", "compartments": "3", "inlet_diameter": "0.1",
    "water_depth": "0.8", "wall_thickness": "0.15", "partition_thickness": "0.1", "进水量": "100", "水力停留时间": "24",
    "水力负荷": "0.3",
}


def frame(spark, **values):
    return spark.range(1).select(*[F.lit(x).cast("string").alias(n) for n, x in values.items()])


def prepared(spark, **values):
    return c.prepare_designs(frame(spark, **values)).first()


def test_defaults_and_constraints(spark):
    row = prepared(spark, 长="10", 宽="5", 高="1.5")
    assert row["is_valid"] and (row["flow_type"], row["compartments"], row["water_depth"]) == ("horizontal", 1, 0.6)
    row = prepared(spark, 长="10", 宽="5", 高="1.5", water_depth="2")
    assert row["errors"] == ["water_depth 必须小于池体高度"]
    assert prepared(spark, **FULL)["errors"] == []


@pytest.mark.parametrize(
    ("change", "errors"),
    [
        ({"长": "abc"}, ["长: could not convert string to float: 'abc'", "缺少必填参数: 长"]),
        ({"宽": " "}, ["缺少必填参数: 宽"]),
        ({"flow_type": ""}, ["缺少必填参数: flow_type"]),
        ({"flow_type": "up"}, ["flow_type 必须是 horizontal, vertical 之一"]),
        ({"compartments": "2.5"}, ["compartments: compartments 必须是整数", "缺少必填参数: compartments"]),
        ({"compartments": "0"}, ["compartments 不能小于 1 个"]),
        ({"高": "25"}, ["高 不能大于 20.0 m"]),
        ({"长": "0.3"}, ["两侧壁厚之和必须小于池体长度"]),
        ({"进水量": "-1"}, ["进水量 不能小于 0.0 m³/d"]),
        ({"进水量": "nan"}, []),
        ({"长": "inf"}, ["长 不能大于 10000.0 m"]),
        ({"长": "10000"}, []),
        ({"flow_type": " 垂直流 "}, []),
        ({"compartments": "1e1"}, []),
    ],
)
def test_rules(spark, change, errors):
    assert prepared(spark, **{**FULL, **change})["errors"] == errors


def test_numeric_columns_and_unknown_names(spark):
    df = spark.createDataFrame([(10.0, 5, 1.5, " x ", "7")], "`长` double, `宽` int, `高` double, site string, no string")
    row = c.prepare_designs(df).first()
    assert row["is_valid"] and row["宽"] == 5.0
    assert (row["site"]["num"], row["site"]["txt"], row["no"]["num"]) == (None, "x", 7.0)


def test_names_and_features(spark, one):
    assert one(c.display_name(F.col("n")), n="COD") == "COD (mg/L)"
    assert one(c.display_name(F.col("n")), n="pH") == "pH"
    assert one(c.unit_of(F.col("n")), n="nothing") is None
    assert c.select_features(frame(spark, 长="1"), ["COD", "长"]).first().asDict() == {"COD": None, "长": "1"}


def test_brief_and_layout(spark):
    def brief(**values):
        df = c.prepare_designs(frame(spark, **values))
        return df.select(c.design_brief(df)).first()[0]

    assert brief(**FULL) == (
        "请绘制一个人工湿地工程平面图，尺寸约为 10.0m x 5.0m x 1.5m，流型为 horizontal，共有 3 个隔间，水力停留时间约 24.0 小时，"
        "水力负荷约 0.30 m³/(m²·d)，请以工程制图风格展示进水、出水、隔断和主要流向。图中应标注隔间编号、水流方向和进水口位置。"
    )
    assert brief(长="10", 宽="5", 高="1.5", 水力负荷="0.3").endswith(
        "请以工程制图风格展示进水、出水、隔断和主要流向。水力负荷约 0.30 m³/(m²·d)，图中应标注隔间编号、水流方向和进水口位置。"
    )
    walls = c.partition_layout(c.prepare_designs(frame(spark, id="a", **FULL), ["id"]), ["id"]).collect()
    assert [w["wall_no"] for w in walls] == [1, 2]
    assert walls[0]["wall_x"] == pytest.approx(9.7 / 3 + 0.1) and walls[0]["opening_y"] == pytest.approx(4.7)
    assert walls[1]["opening_y"] == 0.15 and walls[1]["opening_height"] == pytest.approx(0.28)
    single = c.prepare_designs(frame(spark, id="a", **{**FULL, "compartments": "1"}), ["id"])
    assert c.partition_layout(single, ["id"]).count() == 0


def test_parameter_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"长": 10.0, "flow_type": "horizontal", "宽": None}, ensure_ascii=False), encoding="utf-8")
    df = parameters.load_parameters(spark, str(tmp_path / "a.json"), ["长", "flow_type", "宽", "高"])
    assert df.first().asDict() == {"file": "a.json", "长": "10.0", "flow_type": "horizontal", "宽": None, "高": None}
    parameters.save_parameters(df.drop("file"), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).first()["长"] == "10.0"
    long = {(r["name"], r["value"]) for r in parameters.designs_long(df, "file").collect()}
    assert ("长", "10.0") in long and ("高", None) in long


def test_a_text_is_parsed_once_whatever_rules_look_at_it(spark, folder):
    from paramill.plans import registered

    for name in ("prepare_designs", "partition_layout", "design_brief", "complete_designs"):
        plan = registered.REGISTRY[name](spark, folder)._jdf.queryExecution().optimizedPlan().toString()
        numbers = plan.count("(?:inf(?:inity)?|nan)") + plan.count("|inf(?:inity)?|nan)")
        assert 0 < numbers <= 20, (name, numbers)  # seven texts; more than a hundred when every rule parses its own
        scan = plan[plan.index("Relation") - 400 :]
        assert "Filter" not in scan, name  # no check is pushed down to the scan


def test_designs_are_dealt_to_tasks_by_rows(spark, tmp_path):
    from paramill.plans import sample_inputs

    spark.range(500_001).withColumnRenamed("id", "p_partkey").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    assert sample_inputs.designs(spark, str(tmp_path)).rdd.getNumPartitions() == 11
