"""adplan: retail-media advertising analytics expressed as Spark DataFrame functions."""
