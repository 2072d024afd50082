"""Helpers shared by the tests, under a name that no conftest.py can shadow."""


def small(spark, data, ddl):
    """A frame whose size the optimizer knows (rows of Python objects count as endless)."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL(ddl)
    arrow = to_arrow_schema(schema)
    columns = list(zip(*data)) if data else [[] for _ in arrow]
    return spark.createDataFrame(pa.table([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow), schema)


def rows(df, *order):
    """Collected rows as tuples, sorted."""
    df = df.select(*order) if order else df
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((x is None, str(x)) for x in r))
