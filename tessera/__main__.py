"""Command line: python -m tessera {detect,young,train,predict,clip} ..."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from tessera import jobs
from tessera.operators import detectors


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tessera", description="Finds and counts trees in large GeoTIFFs.")
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, help_: str, *paths: str) -> argparse.ArgumentParser:
        p = commands.add_parser(name, help=help_)
        for path in paths:
            p.add_argument(path)
        p.add_argument("--out-dir", required=True)
        p.add_argument("--rgb-bands", type=int, nargs=3, default=(1, 2, 3), metavar=("R", "G", "B"))
        return p

    def searched(p: argparse.ArgumentParser) -> None:
        for flag, kind in (("--tile-size", int), ("--tile-overlap", int), ("--vegetation-percentile", float), ("--min-score", float)):
            p.add_argument(flag, type=kind)

    p = command("detect", "the generic detector", "image")
    searched(p)
    p.add_argument("--nir-band", type=int)
    for flag in ("--min-crown-radius-px", "--max-crown-radius-px", "--expected-spacing-px"):
        p.add_argument(flag, type=float)
    p.add_argument("--min-row-support", type=int, default=1)
    for flag in ("--disable-row-filter", "--write-annotated-tif", "--debug"):
        p.add_argument(flag, action="store_true")

    p = command("young", "the detector of young trees of known spacing", "image")
    searched(p)
    p.add_argument("--expected-spacing-m", type=float, default=1.5)
    for flag in ("--min-crown-radius-m", "--max-crown-radius-m"):
        p.add_argument(flag, type=float)
    p.add_argument("--min-row-support", type=int, default=2)
    p.add_argument("--write-points-tif", action="store_true")

    p = command("train", "fits a forest on reference points", "image", "reference_points")
    searched(p)
    for flag, default in (("--spacing-m", None), ("--positive-distance-m", 0.55), ("--negative-distance-m", 1.0), ("--negative-ratio", 2.0), ("--anchor-positive-fraction", 0.08)):
        p.add_argument(flag, type=float, default=default)
    for flag, default in (("--sample-tile-size", 512), ("--max-positive", 7000), ("--n-estimators", 220)):
        p.add_argument(flag, type=int, default=default)

    p = command("predict", "finds trees with a fitted forest", "image", "model")
    searched(p)
    p.add_argument("--aoi")
    p.add_argument("--prob-threshold", type=float, default=0.70)

    command("clip", "reference points within a raster", "image", "reference_points")
    return top


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    rgb = tuple(a.rgb_bands)
    own = lambda preset: jobs.presets(preset, a.tile_size, a.tile_overlap, a.vegetation_percentile and a.vegetation_percentile / 100, a.min_score)
    if a.command == "detect":
        got = jobs.run_generic(spark, a.image, a.out_dir, rgb, a.nir_band, a.min_crown_radius_px, a.max_crown_radius_px, a.expected_spacing_px, own(detectors.GENERIC), not a.disable_row_filter, a.min_row_support, a.write_annotated_tif, a.debug)
    elif a.command == "young":
        got = jobs.run_young(spark, a.image, a.out_dir, a.expected_spacing_m, rgb, a.min_crown_radius_m, a.max_crown_radius_m, own(detectors.YOUNG), a.min_row_support, a.write_points_tif)
    elif a.command == "train":
        got = jobs.train(
            spark, a.image, a.reference_points, a.out_dir, rgb, a.spacing_m, a.positive_distance_m, a.negative_distance_m, a.sample_tile_size, a.n_estimators, preset=own(detectors.HYBRID),
            ratio=a.negative_ratio, anchors=a.anchor_positive_fraction, most_positive=a.max_positive,
        )
    elif a.command == "predict":
        got = jobs.predict(spark, a.image, a.model, a.out_dir, a.aoi, a.prob_threshold, own(detectors.HYBRID))
    else:
        got = jobs.clip_references(spark, a.image, a.reference_points, a.out_dir)
    print(json.dumps({"command": a.command, "result": got}))


if __name__ == "__main__":
    main()
