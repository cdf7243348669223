"""Where clips come from: files, groups of files, and arrays."""
