"""sparkseek.streaming"""
