"""Progress operators over streams; each gives the same rows as its batch form."""
