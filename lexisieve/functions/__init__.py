"""Detection: settings, lexicons, views, the kernel and its Column functions."""
