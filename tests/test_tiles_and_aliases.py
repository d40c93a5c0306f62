"""Treemap tiles and the alias table of customer files."""

import math

import pytest

from millrace.functions import text
from millrace.operators import profiling


def test_tiles_cover_the_area_in_proportion(spark):
    rows = [("a", f"g{i}", float(v)) for i, v in enumerate([5, 3, 3, 1, 0.5, 0, -2, 8, 13])] + [("b", "only", 2.0), ("c", "none", 0.0), ("d", None, 1.0), ("d", "x", None)]
    tiles = profiling.treemap(spark.createDataFrame(rows, "chart string, g string, v double"), "g", "v", 30.0, 20.0, ["chart"]).collect()
    mine = [t for t in tiles if t["chart"] == "a"]
    total = sum(v for k, _, v in rows if k == "a" and v > 0)
    value = {g: v for k, g, v in rows if k == "a"}
    assert {t["g"] for t in mine} == {g for g, v in value.items() if v > 0}
    for t in mine:
        assert math.isclose(t["w"] * t["h"], 600 * value[t["g"]] / total, rel_tol=1e-9) and t["x"] >= 0 and t["y"] >= 0 and t["x"] + t["w"] <= 30 + 1e-9 and t["y"] + t["h"] <= 20 + 1e-9
    for i, a in enumerate(mine):
        for b in mine[i + 1 :]:
            assert min(a["x"] + a["w"], b["x"] + b["w"]) - max(a["x"], b["x"]) < 1e-9 or min(a["y"] + a["h"], b["y"] + b["h"]) - max(a["y"], b["y"]) < 1e-9
    assert [(t["chart"], t["g"], t["w"], t["h"]) for t in tiles if t["chart"] in "bcd"] == [("b", "only", 30.0, 20.0), ("d", None, 30.0, 20.0)] or len([t for t in tiles if t["chart"] in "bcd"]) == 2


def test_tiles_in_a_given_order(spark):
    """Halves by weight in the order given: 1 + 1 | 2 across, then 1 | 1 down."""
    rows = [("x", 1.0, 1), ("y", 1.0, 2), ("z", 2.0, 3)]
    tiles = {t["g"]: (t["x"], t["y"], t["w"], t["h"]) for t in profiling.treemap(spark.createDataFrame(rows, "g string, v double, o int"), "g", "v", 4.0, 4.0, order="o").collect()}
    assert tiles == {"x": (0.0, 0.0, 2.0, 2.0), "y": (0.0, 2.0, 2.0, 2.0), "z": (2.0, 0.0, 2.0, 4.0)}


@pytest.mark.parametrize("names,missing", [(["CustomerID", "InvoiceNo", "InvoiceDate", "Quantity", "UnitPrice", "Country", "StockCode"], []), (["Mã khách hàng", "Mã đơn hàng", "Ngày mua", "Số lượng", "Giá", "Quốc gia", "Đánh giá"], []), (["user", "username", "order id"], ["customer", "date", "quantity", "value", "country"])])
def test_customer_headers(names, missing):
    found, lacking = text.customer_columns(names)
    assert lacking == missing and all(v in names for v in found.values() if v)
