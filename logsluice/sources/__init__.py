"""Line sources: text files, directories, growing files and cursor tables."""
