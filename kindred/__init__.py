"""Kindred: clone and near-duplicate detection, and text-corpus operators, as Spark DataFrame programs."""

VERSION = "0.1.0"
