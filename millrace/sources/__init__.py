"""Where rows come from and go to: Parquet folders and keyed tables."""
