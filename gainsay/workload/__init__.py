"""The registered queries: every operator run over the benchmark tables, with reference SQL."""
