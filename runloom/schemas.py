"""Explicit schemas of the campaign files. Component order: 00, 01, 02, 11, 12, 22."""

from __future__ import annotations

from pyspark.sql import types as T

# Column names of the files a campaign writes.
COMPONENTS = ["00", "01", "02", "11", "12", "22"]
STRAIN = [f"strain_{c}" for c in COMPONENTS]
UPDATED_STRAIN = [f"updstrain_{c}" for c in COMPONENTS]
STRESS = [f"stress_{c}" for c in COMPONENTS]
MACRO_STRESS = [f"{s}_macro" for s in STRESS]
NANO_STRESS = [f"{s}_nano" for s in STRESS]
PRESSURES = ["pxx", "pyy", "pzz", "pxy", "pxz", "pyz"]
MACRO_NON_STRESS = ["timestep", "time", "qpid", "cell", "qpoint", "material", *STRAIN, *UPDATED_STRAIN]
NANO_NON_STRESS = [
    "qp_id", "material_id", "time_id", "temperature", "strain_rate", "force_field", "replica_id", *STRAIN,
]


def _fields(ints=(), doubles=(), strings=(), order=None) -> T.StructType:
    kinds = {**{n: T.IntegerType() for n in ints}, **{n: T.DoubleType() for n in doubles},
             **{n: T.StringType() for n in strings}}
    return T.StructType([T.StructField(n, kinds[n]) for n in order])


BOUNDARY_FORCE = _fields(
    ints=["timestep"], doubles=["time", "resulting_force"], order=["timestep", "time", "resulting_force"]
)
MACRO_HISTORY = _fields(
    ints=["timestep", "qpid", "cell", "qpoint"],
    doubles=["time", *STRAIN, *UPDATED_STRAIN, *STRESS],
    strings=["material"],
    order=[*MACRO_NON_STRESS, *STRESS],
)
NANO_HISTORY = _fields(
    ints=["qp_id", "time_id", "replica_id"],
    doubles=["temperature", "strain_rate", *STRAIN, *STRESS],
    strings=["material_id", "force_field"],
    order=[*NANO_NON_STRESS, *STRESS],
)
STRAIN_HISTORY = _fields(doubles=STRAIN, order=STRAIN)
PARAMETERS = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("dtype", T.StringType()),
        T.StructField("min", T.StringType()),
        T.StructField("max", T.StringType()),
        T.StructField("default", T.StringType()),
        T.StructField("lower", T.StringType()),
        T.StructField("upper", T.StringType()),
        T.StructField("dist", T.StringType()),
        T.StructField("selected", T.BooleanType()),
    ]
)
