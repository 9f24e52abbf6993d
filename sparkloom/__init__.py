"""Sparkloom: an analytics engine on PySpark."""
