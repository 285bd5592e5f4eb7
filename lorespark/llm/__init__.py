"""Operators for preparing training data, as Spark jobs.

Each module holds one operator with its own general interface; ``queries``
applies them to the driver tables with production parameters.
"""
