"""threadmill: assistant-transcript analytics as Spark plans.

Sub-packages hold pure ``DataFrame -> DataFrame`` functions: ``sources`` reads logs, ``functions``
holds column expressions, ``operators`` the relational operators, ``plans`` the named queries with
their SQL counterparts, ``streaming`` the capture path.
"""
