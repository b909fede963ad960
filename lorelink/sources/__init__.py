"""Where knowledge bases and requests come from."""
