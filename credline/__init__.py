"""credline: a PySpark engine for curating text annotations of video frames.

Operators are plain ``DataFrame -> DataFrame`` transforms or ``Column -> Column``
functions built from Spark SQL expressions, so Catalyst plans, prunes and
pushes down everything; Python only runs inside ``mapInPandas`` surfaces
that apply user-supplied models.
"""

__version__ = "0.1.0"
