"""Readers and writers of the binary and text formats.

Files are read through Spark's own ``binaryFile``, ``text``, ``csv`` and ``image`` sources, so any store that
Spark opens will do, and large files are cut into records on the executors.
"""
