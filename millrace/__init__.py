"""Dataset preparation on PySpark: lazy DataFrame -> DataFrame operators.

Import what you need from ``operators``, ``sources``, ``functions``, ``plans`` and
``streaming``. Nothing is imported here, which keeps Python workers quick to start.
"""
