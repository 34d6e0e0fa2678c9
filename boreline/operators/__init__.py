"""DataFrame-to-DataFrame operators over survey and station tables."""
