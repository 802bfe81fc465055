"""sparkseek.sources"""
