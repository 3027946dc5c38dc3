"""Functions written in Java, run by executors inside Spark's own projections.

The sources in ``java/`` are compiled on the driver with Janino, the compiler that Spark brings for its generated code;
nothing has to be installed or built.  The classes reach the executors as a jar, like any other dependency: Spark sends
it to each executor, those that replace lost ones too.
"""

from __future__ import annotations

import io
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

from .common import new_path

_ready: dict[tuple[str, str], object] = {}


def _loader(spark: SparkSession, source: str):
    """Compile a source, add its classes to the application; a class loader for the driver. Once an application."""
    key = (spark.sparkContext.applicationId, source)
    if key not in _ready:
        jvm = spark._jvm
        compiler = jvm.org.codehaus.janino.SimpleCompiler()
        compiler.setParentClassLoader(jvm.java.lang.Thread.currentThread().getContextClassLoader())
        compiler.cook((Path(__file__).parent / "java" / f"{source}.java").read_text())
        jar = io.BytesIO()
        with zipfile.ZipFile(jar, "w") as z:
            for name, code in dict(compiler.getBytecodes()).items():
                z.writestr(name.replace(".", "/") + ".class", bytes(code))
        path = jvm.org.apache.hadoop.fs.Path(f"{new_path(spark, source)}.jar")
        out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path)
        out.write(jar.getvalue())
        out.close()
        spark.sparkContext._jsc.addJar(path.toString())
        _ready[key] = compiler.getClassLoader()
    return _ready[key]


def _objects(spark: SparkSession, args: tuple):
    array = spark.sparkContext._gateway.new_array(spark._jvm.java.lang.Object, len(args))
    for k, x in enumerate(args):
        array[k] = bytearray(x) if isinstance(x, bytes) else x
    return array


def register(spark: SparkSession, name: str, source: str, function: str, returns: str, *args) -> str:
    """Register the class ``voxloom.<source>$<function>``, made with args, as SQL function ``name``; its name.

    A name that is registered again stands for the new object in frames made from then on.
    """
    made = _loader(spark, source).loadClass(f"voxloom.{source}${function}").getConstructors()[0].newInstance(_objects(spark, args))
    spark._jsparkSession.udf().register(name, made, spark._jvm.org.apache.spark.sql.types.DataType.fromDDL(returns))
    return name


def call(spark: SparkSession, source: str, method: str, *args):
    """The static method of ``voxloom.<source>`` with this name and number of arguments, on the driver."""
    found = [m for m in _loader(spark, source).loadClass(f"voxloom.{source}").getMethods() if m.getName() == method and m.getParameterCount() == len(args)]
    return found[0].invoke(None, _objects(spark, args))
