from tidemark.config import Params
from tidemark.session import cluster_settings


def test_partitions_follow_the_input():
    big = cluster_settings(100 * 10**12, 8000)
    assert 100 * 10**12 / int(big["spark.sql.shuffle.partitions"]) <= 192 << 20
    assert cluster_settings(10**9, 64)["spark.sql.shuffle.partitions"] == "128"


def test_parameters_from_a_parsed_file(params):
    same = Params.from_mapping(
        {
            "window_start": "2025-01-01T00:00:00", "window_end": "2025-06-15T12:00:00",
            "build_as_of": "2025-06-15T12:00:00", "vintage_first": "2025-01-31",
            "sensitivity_windows": [30, 60, 90, 120, 180],
        }
    )
    assert same == params
