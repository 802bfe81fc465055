"""sparkseek.plans"""
