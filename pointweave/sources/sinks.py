"""Writers of maps, clouds, masks, packets and reports."""

from __future__ import annotations

import base64
import json
import zlib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_map(voxels: DataFrame, votes: DataFrame, path: str, k: int) -> None:
    """The map as published and, beside it, the whole map: both from one persisted plan."""
    from pointweave.operators.carving import withheld

    voxels = voxels.persist()
    try:
        voxels.write.mode("errorifexists").parquet(f"{path}/raw")
        withheld(voxels, votes, k).write.mode("errorifexists").parquet(f"{path}/map")
    finally:
        voxels.unpersist()


def cloud_records(points: DataFrame) -> DataFrame:
    """Packed 28-byte records: x, y, z, rgb as float bits, class, confidence, has_rgb, padding; with one hash per frame.

    Records are encoded in Arrow batches per frame.
    """

    def encode(pdf: pd.DataFrame) -> pd.DataFrame:
        import hashlib

        import numpy as np

        pdf = pdf.sort_values("pt")
        kind = np.dtype([("x", "<f4"), ("y", "<f4"), ("z", "<f4"), ("rgb", "<u4"), ("cls", "<u2"), ("pad", "V2"), ("conf", "<f4"), ("has", "u1"), ("end", "V3")])
        rec = np.zeros(len(pdf), kind)
        for c in ("x", "y", "z", "rgb", "cls", "conf", "has"):
            rec[c] = pdf[c].to_numpy()
        body = rec.tobytes()
        return pd.DataFrame({"frame": [pdf["frame"].iloc[0]], "n": [len(pdf)], "sha256": [hashlib.sha256(body).hexdigest()], "data": [body]})

    return points.groupBy("frame").applyInPandas(encode, "frame int, n int, sha256 string, data binary")


def write_masks(masks: DataFrame, path: str) -> None:
    """Masks of sweeps, a folder per frame."""
    masks.repartition("frame").write.mode("errorifexists").partitionBy("frame").parquet(path)


def write_topics(topics: dict[str, DataFrame], path: str) -> None:
    """A bag as one Parquet table per topic."""
    for name, rows in topics.items():
        rows.write.mode("errorifexists").parquet(f"{path}/{name.strip('/').replace('/', '__')}")


def write_features(features: DataFrame, path: str, log: str = "log") -> None:
    """A cache of features, a folder per log, with each log's number of rows beside it; an existing one is an error."""
    features.write.mode("errorifexists").partitionBy(log).parquet(f"{path}/features")
    features.groupBy(log).agg(F.count("*").alias("n")).write.mode("errorifexists").parquet(f"{path}/counts")


def json_report(rows: DataFrame) -> DataFrame:
    """Rows as JSON text; a NaN or an infinity is an error."""
    bad = F.lit(False)
    for f in rows.schema.fields:
        if f.dataType.simpleString() in ("double", "float"):
            bad = bad | F.isnan(f.name) | (F.abs(f.name) == float("inf"))
    ok = F.when(F.coalesce(bad, F.lit(False)), F.raise_error(F.lit("a report holds NaN or infinity")).cast("boolean")).otherwise(F.lit(True))
    return rows.where(ok).select(F.to_json(F.struct(*rows.columns)).alias("value"))


def encode_packet(packet: dict, most: int = 1 << 20) -> str:
    """A JSON packet as compressed text, of at most ``most`` bytes before compression."""
    body = json.dumps(packet, allow_nan=False, separators=(",", ":"), sort_keys=True).encode()
    if len(body) > most:
        raise ValueError("the packet is too large")
    return base64.b64encode(zlib.compress(body)).decode()


def decode_packet(text: str, keys: set[str], most: int = 1 << 20) -> dict:
    """The packet of encode_packet(): exact keys, no larger than ``most`` when expanded."""
    box = zlib.decompressobj()
    body = box.decompress(base64.b64decode(text, validate=True), most + 1)
    if len(body) > most or box.unconsumed_tail:
        raise ValueError("the packet is too large")
    packet = json.loads(body)
    if set(packet) != keys:
        raise ValueError("the packet has other keys")
    return packet
