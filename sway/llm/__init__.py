"""Operators of a large-scale training-data pipeline, one module per operator.

Nothing outside this package imports it; ``__spark_entry__.py`` adds its queries when the
package is present.
"""
