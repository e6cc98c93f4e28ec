"""The registered queries, their input views over the test tables, and their SQL counterparts."""
