"""Row types of the takeoff model."""

from __future__ import annotations

from pyspark.sql import types as T

BBOX = T.StructType([T.StructField(c, T.DoubleType()) for c in ("x0", "y0", "x1", "y1")])

#: A takeoff item. ord is the row's place in its source: rows of a DataFrame have no order of their own.
ITEM = T.StructType([
    T.StructField("project_id", T.LongType()),
    T.StructField("ord", T.LongType(), False),
    T.StructField("page", T.IntegerType(), False),
    T.StructField("name", T.StringType(), False),
    T.StructField("spec", T.StringType()),
    T.StructField("quantity", T.DoubleType(), False),
    T.StructField("unit", T.StringType(), False),
    T.StructField("location", T.StringType()),
    T.StructField("bbox", BBOX),
    T.StructField("category", T.StringType()),
    T.StructField("confidence", T.DoubleType(), False),
    T.StructField("source", T.StringType()),
])

DICTIONARY = "ord int, canonical string, category string, unit string, aliases array<string>"
PRICE = "ord int, unit_price double, unit string, material_ratio double, spec string, category string, name string, vendor_id string, notes string"
LIFE = "ord int, keywords array<string>, years int, label string"
PLAN = "ord int, name string, interval_months int, monthly_fee int, scope string"
JOB = "ord int, name string, keywords array<string>, price_min long, price_max long, work string, warranty_months int"
MUNICIPALITY = "ord int, name string, aliases array<string>, form_name string, authority string, submit string, documents array<string>, notes string"
ROOM = "name string, width_m double, depth_m double, height_m double, floor_area_m2 double, wall_area_m2 double, openings_m2 double, exterior_wall_len_m double, surfaces array<string>, material string, thickness_mm int"
RISER = "name string, floors int, floor_height_m double, count int, spec string, material string, branch_per_floor_m double, fittings_per_floor double, valves_per_floor double, location string"
MEASURE = "kind string, name string, width_mm string, height_mm string, dia_mm string, length_m string, count string, location string, spec string, unit string, confidence string"
CORRECTION = "ts string, project string, source string, note string, before struct<name:string,spec:string,quantity:double,unit:string,location:string,category:string>, after struct<name:string,spec:string,quantity:double,unit:string,location:string,category:string>"
